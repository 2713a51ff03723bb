"""Spelling variants: words one edit apart, grouped under the form that is far more frequent, by pivotal grams.

Bigrams are ordered from rare to frequent. A word's *prefix* are its three rarest bigrams (q * edits + 1); its *pivots* are two of
them that don't overlap, chosen by dynamic programming for the least frequency in all. One edit can spoil one pivot only. If of
two words r and s the prefix of r ends no later in the order than that of s, then a pivot of r that is left must stand in the
prefix of s: so every near pair meets when all pivots are looked up among all prefixes.

Position limits. With one edit, either the word up to and with its first pivot is left as it is, or the word from its second pivot
on. So the first pivot is looked up at equal places from the start, and the second, all read backwards, at equal places from the
end. Of the rest, which holds the edit, one half is left as well: the further half or, cut short by a letter, the nearer one. So a key
has the other word's length (one less, equal, one more), all that comes before the pivot's end, and a half of the rest: twelve keys a
word, met by four for each bigram of a prefix. Keys are hashes. The join then compares the parity of letter counts, which one edit
changes in two places at most, and last the words themselves by a banded edit distance; so hashes, signatures and the order of
bigrams change the work only.

Equal bigrams. A prefix takes every bigram that isn't after its last one in the order. Of equal bigrams, the first five are enough: pivots
are among the first three of their kind in their word, and one edit makes at most two new ones before them.

The order is a broadcast table of at most ``table`` frequent bigrams; others count as never met and come first. Words are counted in
bounded tables where texts are read. Candidates meet by equal parts of words, never all pairs of a bigram.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import map_texts, new_folder, remove, saved, slices

LETTERS = "[a-zÀ-ÿ]+"
_SHORTEST = 4  # a prefix has three bigrams


def word_counts(docs: DataFrame, pattern: str = LETTERS, shortest: int = 7, least: int = 2, change: Callable | None = None, id_col: str = "doc_id", text_col: str = "text", held: int = 200_000) -> DataFrame:
    """(word, n): matches of ``pattern`` in the whole texts with A-Z in lower case, of at least ``shortest`` code points and ``least``
    occurrences. ``change(id)`` gives a function that replaces a match. Null texts have no words. A task sums up ``held`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, sums = re.compile(pattern).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lower = (text.as_py() or "").encode().lower().decode()
                own = Counter(w for w in find(lower) if len(w) >= shortest)
                if change:
                    changed = change(id_)
                    for w, n in own.items():
                        w = changed(w)
                        if len(w) >= shortest:
                            sums[w] += n
                else:
                    sums.update(own)
                if len(sums) > held:
                    yield out()
                    sums.clear()
        yield out()

    rows = map_texts(docs.select(id_col, text_col), run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _frequencies(words: DataFrame, table: int) -> dict[str, int]:
    """In how many words each of the ``table`` most frequent bigrams stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["gram", "n"])

        for batch in slices(batches, 4096):
            for w in batch.column(0).to_pylist():
                sums.update({w[i : i + 2] for i in range(len(w) - 1)})
                if len(sums) > table:
                    yield out()
                    sums.clear()
        yield out()

    rows = map_texts(words.select("word"), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in rows.orderBy(F.desc("n"), "gram").limit(table).collect()}


def cheapest_disjoint(grams: list[tuple[int, int]], wanted: int = 2, width: int = 2) -> tuple[int, ...]:
    """Of (place, cost), the places of ``wanted`` grams, ``width`` or more apart, with the least cost in all."""
    grams = sorted(grams)
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] * (len(grams) + 1)] + [[None] * (len(grams) + 1) for _ in range(wanted)]
    for j in range(1, wanted + 1):
        for i, (place, cost) in enumerate(grams):
            free = sum(p <= place - width for p, _ in grams[:i])  # grams that end before this one begins
            before, without = best[j - 1][free], best[j][i]
            taken = before and (before[0] + cost, (*before[1], place))
            best[j][i + 1] = min((x for x in (without, taken) if x), default=None)
    return best[wanted][-1][1]


def pivots_and_prefix(word: str, frequency: dict[str, int]) -> tuple[tuple[int, ...], list[int]]:
    """Places of the two pivots and of the bigrams of the prefix."""
    places = defaultdict(list)
    for i in range(len(word) - 1):
        if len(kind := places[word[i : i + 2]]) < 5:
            kind.append(i)
    order = sorted((frequency.get(g, 0), g) for g in places)
    rarest, prefix = [], []
    for n, g in order:
        if len(rarest) >= 3:
            break
        rarest += [(i, n) for i in places[g][:3]][: 3 - len(rarest)]
        prefix += places[g]
    return cheapest_disjoint(rarest), prefix


def _hashed(side: str, length: int, end: int, middle: int, word: str, shift: int = 0) -> tuple[int, int]:
    """Keys for a word that is to have ``length`` letters and keeps those before ``end``: with the rest before ``middle``, short of a
    letter, and with the rest after it."""
    further = f"{side}{length}:{word[: max(middle - 1, end)]}"
    nearer = f"{side}{length}.{end}:{word[:end]}:{word[middle - shift :]}"
    return xxhash.xxh64_intdigest(further) - (1 << 63), xxhash.xxh64_intdigest(nearer) - (1 << 63)


def looked_up(word: str, first: int, second: int) -> set[int]:
    """Keys under which the pivots at ``first`` and ``second`` look for words of one edit."""
    keys = set()
    for side, w, end in (("<", word, first + 2), (">", word[::-1], len(word) - second)):
        for d in (-1, 0, 1):
            length = len(w) + d
            keys.update(_hashed(side, length, end, end + (length - end) // 2, w, d))
    return keys


def met(word: str, prefix: list[int]) -> set[int]:
    """Keys under which the bigrams of a prefix are found."""
    keys, back, n = set(), word[::-1], len(word)
    for i in prefix:
        for side, w, end in (("<", word, i + 2), (">", back, n - i)):
            keys.update(_hashed(side, n, end, end + (n - end) // 2, w))
    return keys


def signature(word: str) -> int:
    """A bit for each letter (modulo 63) that stands an odd number of times."""
    bits = 0
    for c in word:
        bits ^= 1 << ord(c) % 63
    return bits


def _keys(words: DataFrame, frequency: dict[str, int]) -> DataFrame:
    """(key, pivot, sign, word, n): the keys of a word's pivots and of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048, 1 << 20):
            keys, pivot, row, signs = [], [], [], []
            for k, w in enumerate(batch.column(0).to_pylist()):
                pivots, prefix = pivots_and_prefix(w, frequency)
                looked, found = looked_up(w, *pivots), met(w, prefix)
                keys += [*looked, *found]
                pivot += [True] * len(looked) + [False] * len(found)
                row += [k] * (len(looked) + len(found))
                signs.append(signature(w))
            at = pa.array(row, pa.int32())
            columns = [pa.array(keys, pa.int64()), pa.array(pivot, pa.bool_()), pa.array(signs, pa.int64()).take(at), batch.column(0).take(at), batch.column(1).take(at)]
            yield pa.record_batch(columns, ["key", "pivot", "sign", "word", "n"])

    return map_texts(words.select("word", "n"), run, "key long, pivot boolean, sign long, word string, n long")


def near_words(words: DataFrame, table: int = 65_536) -> DataFrame:
    """(word, n, near, near_n): for every word of (word, n) all words that differ by exactly one inserted, deleted or replaced code point.
    Words are distinct and have four code points or more; null words are left out."""
    words = words.where(F.length("word") >= _SHORTEST)
    keys = saved(_keys(words, _frequencies(words, table)))
    pivots = keys.where("pivot").drop("pivot")
    prefixes = keys.where("not pivot").select("key", F.col("sign").alias("near_sign"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    alike = F.bit_count(F.col("sign").bitwiseXOR(F.col("near_sign"))) <= 2
    found = pivots.join(prefixes, "key").where(alike & (F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    ordered = F.col("word") < F.col("near")

    def pick(a: str, b: str, name: str) -> Column:
        return F.when(ordered, F.col(a)).otherwise(F.col(b)).alias(name)

    pairs = found.select(pick("word", "near", "word"), pick("n", "near_n", "n"), pick("near", "word", "near"), pick("near_n", "n", "near_n"))
    pairs = pairs.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def _ends(links: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends, by doubling; frequencies grow by a factor in each step, so chains are short."""
    spark, folder = links.sparkSession, new_folder(links.sparkSession)
    ends = saved(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), folder)
    while ends.where("moved").limit(1).count():
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        past, folder = folder, new_folder(spark)
        ends = saved(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), folder)
        remove(spark, past)
    return ends.drop("moved")


def variants(words: DataFrame, factor: int = 10, table: int = 65_536) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row a word of (word, n).

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least ``factor`` times the word's own, else
    null; root: from the word, its form's form and so on to the last, the word itself if it has none; n_near: how many near words.
    Words of under four code points have no near words; a null word is left out; an empty table gives no rows; other columns are dropped.
    """
    if factor < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = saved(words.where("word is not null").select("word", "n"))
    alone = words.withColumns({"near": F.lit(None).cast("string"), "near_n": F.lit(None).cast("long")})
    rows = alone.unionByName(near_words(words, table)).groupBy("word").agg(
        F.max("n").alias("n"), F.count("near").alias("n_near"), F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    )
    better = -F.col("best.less") >= F.col("n") * factor
    rows = saved(rows.select("word", F.when(better, F.col("best.near")).alias("form"), "n", "n_near", F.when(better, -F.col("best.less")).alias("form_n")))
    found = rows.join(_ends(rows.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
