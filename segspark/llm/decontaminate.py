"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become sequences of tokens, and tokens with a type become placeholders: numbers, names (capitalised words that don't
begin a sentence; a word all in capitals after another capital letter is none) and units. A capitalised word that begins a sentence may be a name or not, so windows that hold one are taken
twice: with the word, and with a name in its place. Windows without any other word than placeholders say nothing about a question:
they are compared by their values. Windows of the documents are hash-joined with those of the benchmark items, where they are read;
only what met is shuffled, with the values of its slots. The windows of an item that meet a document at nearly the same place
(differences of places within a few tokens, as words may have been put in or left out) are chained in order, and where a chain
holds enough of an item's windows its slots are compared: a re-parameterised question gives every value of the item one value
in the document, and that everywhere. Chains with inconsistent slots aren't reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units that become placeholders. Fixed values.
UNITS = "% $ € £ ° km m cm mm miles mile feet foot inch inches kg g mg lb lbs pounds ounces tons l ml liters litres gallons hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents percent degrees mph kmh kwh watts volts".split()
_TOKEN = r"(?<=[\p{L}\p{N},;:)]) (?!(?<=\p{Lu} )\p{Lu}+(?!\p{L}))\p{Lu}[\p{L}'’-]*|\d(?:[\d.,]*\d)?|[\p{L}]+|[%$€£°]"
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"


def tokens(text: Column) -> Column:
    """The tokens of a text, in order; a name keeps the space before it, which tells it from other words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def canonical(token: Column) -> Column:
    low = F.lower(token)
    return F.when(token < "!", NAME).when((token >= "0") & (token < ":"), NUMBER).when(low.isin(UNITS), UNIT).otherwise(low)


def _first(token: Column) -> Column:
    """True for capitalised words that aren't told to be names by what is before them: most begin a sentence."""
    letter = F.substring(token, 1, 1)
    return (token >= "A") & (letter != F.lower(letter))


def _named(token: Column) -> Column:
    """The canonical token, with names for the capitalised words that begin sentences."""
    return F.when(_first(token), NAME).otherwise(canonical(token))


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _probes(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, tag, at, kind, x, w, h, raw): the windows of all items, each hash once an item; and (item, tag, item_tokens, of).

    kind: the first place of the item with the same window, names in place of words that begin sentences; ``of`` counts kinds.
    raw: the hash is of the values, as the window holds placeholders only. tag tells rows of one item id apart by text."""
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(text_col)).alias("t")).dropDuplicates().where(F.size("t") > 1)
    items = items.withColumn("tag", F.xxhash64("t")).withColumn("w", F.least(F.size("t") - 1, F.lit(width)))
    items = items.withColumn("own", F.transform("t", lambda x: F.xxhash64(canonical(x)))).withColumn("named", F.transform("t", lambda x: F.xxhash64(_named(x))))
    items = items.withColumn("plain", F.transform("t", lambda x: F.xxhash64(canonical(F.ltrim(x)))))  # as in a copy all in capitals or without any
    items = items.withColumn("slots", F.transform("t", lambda x: canonical(x).isin(NUMBER, NAME, UNIT)))

    def window(i: Column) -> Column:
        def hashed(name: str, *salt: Column) -> Column:  # of as many elements as the item's windows have
            whens = F.lit(None).cast("long")
            for w in range(1, width + 1):
                whens = F.when(F.col("w") == w, _hash(*salt, *[F.get(name, i + k) for k in range(w)])).otherwise(whens)
            return whens

        x = F.slice("t", i + 1, F.col("w"))
        return F.struct(i.alias("at"), x.alias("x"), hashed("own").alias("own_h"), hashed("named").alias("named_h"), hashed("plain").alias("plain_h"), hashed("t", F.lit("raw")).alias("raw_h"), F.forall(F.slice("slots", i + 1, F.col("w")), lambda s: s).alias("raw"))

    found = items.select("item", "tag", "t", "w", F.inline(F.transform(F.sequence(F.lit(1), F.size("t") - F.col("w")), window)))
    same = F.when(F.col("raw"), F.col("raw_h")).when(F.col("w") == width, F.col("named_h")).otherwise(F.col("own_h"))
    found = found.withColumn("kind", F.min("at").over(Window.partitionBy("item", "tag", same)))
    sizes = found.groupBy("item", "tag").agg(F.first("t").alias("item_tokens"), F.countDistinct("kind").alias("of"))
    hashes = F.when(F.col("raw"), F.array("raw_h")).when(F.col("w") == width, F.array_distinct(F.array("own_h", "named_h", "plain_h"))).otherwise(F.array_distinct(F.array("own_h", "plain_h")))
    each = found.withColumn("h", F.explode(hashes)).groupBy("item", "tag", "h").agg(F.min_by(F.struct("at", "kind", "x", "w", "raw"), "at").alias("p"))
    return each.select("item", "tag", "h", "p.*"), sizes


def _doc_windows(rows: DataFrame, widths: list[int], width: int, raw: bool) -> DataFrame:
    """(id, row, t, lows, doc_at, h): windows of all wanted widths, with words as they are, with names in their place where that differs,
    and by values if ``raw``. The tokens stay beside them; they are copied only for windows that meet an item."""
    name = F.xxhash64(F.lit(NAME))
    rows = rows.withColumn("own", F.transform("t", lambda x: F.xxhash64(canonical(x))))
    # Each word in lower case once, so that a lookup is as long as the vocabulary and not as the text.
    rows = rows.withColumn("lows", F.array_distinct(F.filter("t", lambda x: (x >= "A") & ~_first(x))))
    rows = rows.withColumn("named", F.zip_with("t", "own", lambda t, h: F.when(_first(t), name).otherwise(h)))

    def cut(name: str, w: int) -> list[Column]:  # elements one by one, as slice would copy the whole array for each window
        return [F.get(name, F.col("doc_at") + k) for k in range(w)]

    hashes = []
    for w in widths:
        own = [_hash(*cut("own", w))] + ([_hash(*cut("named", w))] if w == width else []) + ([_hash(F.lit("raw"), *cut("t", w))] if raw else [])
        hashes += [F.when(F.col("doc_at") <= F.size("t") - w, h) for h in own]
    # Places are generated, and hashed and joined in the same stage of generated code, so that tokens aren't copied for each window.
    # Outer, as Spark else infers a filter on the array and makes it a second time; the join drops nulls.
    placed = rows.select("id", "row", "t", "lows", "own", "named", F.posexplode_outer("own").alias("doc_at", "one"))
    return placed.select("id", "row", "t", "lows", "doc_at", F.explode(F.array_distinct(F.array(*hashes))).alias("h"))


def _chain(runs: Column) -> Column:
    """The windows (at, kind, shift, slots) of ``runs``, from the run with most windows on: those that are at a place not yet held
    and keep the order of item and document."""
    none = F.array().cast("array<struct<at:int,kind:int,shift:int,slots:array<struct<x:string,y:string,word:boolean>>>>")

    def add(held: Column, run: Column) -> Column:
        def fits(n: Column) -> Column:
            place = n["at"] + n["shift"]
            return F.forall(held, lambda c: F.when(c["at"] < n["at"], c["at"] + c["shift"] < place).when(c["at"] > n["at"], c["at"] + c["shift"] > place).otherwise(F.lit(False)))

        return F.concat(held, F.filter(run["windows"], fits))

    return F.aggregate(runs, none, add)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 6, coverage: float = 0.6, slack: int = 16, broadcast_windows: int = 500_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Return (``id_col``, ``item_col``, place, windows, coverage, changed, contaminated, row), a row for each document and item that met.

    place: the first document token of the alignment with most of the item's windows; windows: the item's kinds of windows found
    there or in order at alignments not more than ``slack`` tokens apart, with ``coverage`` their share, at least the parameter
    (windows that stand in an item more than once are one kind); changed: slots whose value isn't the item's (0: all values are its
    own); contaminated: true, as chains with inconsistent slots aren't returned. Slots are compared in the windows that met only. A
    word that begins a sentence is a slot unless item or document have it, or what stands for it, in lower case. Of several chains of
    one pair the one with most windows, then the first, is returned. An item's first token is left out of its windows, as it may look
    like a name within a text; items of one token or none (nulls included) never match, those of at most ``width`` tokens match as a
    whole, with the words that begin sentences as they are. Null texts match nothing; null ids are carried through, and rows with the
    same id and text count once (row: the hash of the text). Other columns are left out.
    """
    probes, sizes = _probes(benchmark, width, item_col, item_text_col)
    about = probes.groupBy("w", "raw").count().collect()  # at most `width` numbers
    widths, raw = sorted({r.w for r in about}), any(r.raw for r in about)
    probes = probes.drop("raw")
    if sum(r["count"] for r in about) <= broadcast_windows:  # some 200 bytes each; beyond that the join is shuffled
        probes = F.broadcast(probes)
    text = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), tokens(F.col(text_col)).alias("t"))
    if not widths:
        text, widths = text.limit(0), [width]
    met = _doc_windows(text, widths, width, raw).join(probes, "h")

    def word(k: int) -> Column:
        """Whether a pair of first words are no names, as the document has one of them in lower case."""
        x, y = F.get("x", F.lit(k)), F.get("t", F.col("doc_at") + k)
        return F.coalesce((_first(x) & F.array_contains("lows", F.lower(x))) | (_first(y) & F.array_contains("lows", F.lower(y))), F.lit(False))

    pair = ["id", "row", "item", "tag"]
    # What is kept of the document is cut out here, in generated code, before any row is stored.
    met = met.select(*pair, (F.col("doc_at") - F.col("at")).alias("shift"), "at", "kind", "x", F.slice("t", F.col("doc_at") + 1, F.col("w")).alias("y"), F.array(*map(word, range(width))).alias("word"))
    met = met.groupBy(*pair, "shift", "at").agg(*[F.first(c).alias(c) for c in ("kind", "x", "y", "word")])
    typed = F.filter(F.arrays_zip("x", "y", F.slice("word", F.lit(1), F.size("x")).alias("word")), lambda p: _named(p["x"]).isin(NUMBER, NAME, UNIT) & (_named(p["x"]) == _named(p["y"])))
    met = met.withColumn("slots", typed)
    runs = met.groupBy(*pair, "shift").agg(F.collect_list(F.struct("at", "kind", "shift", "slots")).alias("windows"))  # at most the item's windows
    # Shifts within `slack` of each other share one of two bands, and each shift also stands alone; a band has at most 2 * slack shifts.
    band = F.floor(F.col("shift") / slack).cast("int")
    bands = F.explode(F.array(*[F.struct(F.lit(alone).alias("alone"), k.alias("k")) for alone, k in ((False, band), (False, band + 1), (True, F.col("shift")))]))
    run = F.struct(F.size("windows").alias("n"), (-F.col("shift")).alias("back"), "windows")
    found = runs.withColumn("band", bands).groupBy(*pair, "band").agg(F.sort_array(F.collect_list(run), asc=False).alias("runs"))

    def kinds(windows: Column) -> Column:
        return F.size(F.array_distinct(F.transform(windows, lambda c: c["kind"])))

    sized = sizes.select(F.col("item").alias("item2"), F.col("tag").alias("tag2"), "item_tokens", "of")
    hopeful = found.join(sized, F.col("item").eqNullSafe(F.col("item2")) & (F.col("tag") == F.col("tag2"))).where(kinds(F.flatten(F.transform("runs", lambda r: r["windows"]))) / F.col("of").cast("double") >= coverage)
    chained = hopeful.withColumn("chain", _chain(F.col("runs"))).withColumn("windows", kinds(F.col("chain")).cast("long"))
    enough = chained.withColumn("coverage", F.col("windows") / F.col("of").cast("double")).where(F.col("coverage") >= coverage)

    def known(token: Column) -> Column:
        return _first(token) & F.array_contains("item_tokens", F.lower(token))

    slots = F.filter(F.flatten(F.transform("chain", lambda c: c["slots"])), lambda p: ~p["word"] & ~known(p["x"]) & ~known(p["y"]))
    enough = enough.withColumn("slots", F.array_distinct(F.transform(slots, lambda p: F.struct(F.ltrim(p["x"]).alias("x"), F.ltrim(p["y"]).alias("y")))))
    kept = enough.where(F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda p: p["x"]))))
    kept = kept.select("id", "row", "item", F.greatest(-F.col("runs")[0]["back"], F.lit(0)).alias("place"), "windows", "coverage", F.size(F.filter("slots", lambda p: p["x"] != p["y"])).cast("long").alias("changed"))
    best = kept.groupBy("id", "row", "item").agg(F.max_by(F.struct("place", "windows", "coverage", "changed"), F.struct(F.col("windows"), -F.col("place"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.place").cast("long").alias("place"), "b.windows", "b.coverage", "b.changed", F.lit(True).alias("contaminated"), F.col("row"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` that met no item, with all their columns. The hits, not the texts, are dealt out where they are few
    enough for Spark to broadcast them."""
    hits = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **parameters).select(F.col(id_col).alias("__id"), F.col("row").alias("__row")).distinct()
    own = F.xxhash64(docs[text_col])
    return docs.join(hits, docs[id_col].eqNullSafe(hits["__id"]) & (own == hits["__row"]), "left_anti")
