"""The queries of this subpackage, thin over its operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from segspark.llm.bpe import digests, round_trip

    return digests(round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from segspark.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.embedding_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.secret_scan import listed, scan

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.sharding import kd_shards

    found = kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def one_letter_less(doc_id):
    """Where 31 divides the CRC-32 of ``<doc_id>:<word>``, the word without one letter; a null id is written as nothing."""
    from zlib import crc32

    start = crc32(f"{'' if doc_id is None else doc_id}:".encode())

    def changed(word: str) -> str:
        h = crc32(word.encode(), start)
        return word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]

    return changed


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.spelling import variants, word_counts

    return variants(word_counts(table(spark, sf_dir, "documents"), change=one_letter_less))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.mixing import mix, taken

    found = taken(mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1]))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from segspark.llm.merkle import fold, folded, leaf, manifest, proof_digest, proofs

    names = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(chosen, leaf([*map(F.col, names[:-1]), folded(F.col("text"))]))
    m = manifest(table(spark, sf_dir, "documents"), names, extra={"tampered": tampered})
    rows = proofs(m).withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
    root = F.lit(m.root).cast("string")
    return rows.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


_FUNCTIONS = (
    op1_bpe_round_trip, op2_token_counts, op3_toxicity, op4_simhash, op5_license_scan, op6_decontamination, op7_substring_dedup,
    op8_embedding_dedup, op9_secrets, op10_kd_shards, op11_spelling_variants, op12_mixing, op13_merkle_manifest,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _FUNCTIONS}

#: CRC-32 over lists of bytes, by a table of its 256 steps.
_CRC = """steps as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
  from (select unnest(range(256)) as i))"""


def _crc32(raw: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {raw}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _merkle_sql(levels: int = 6) -> str:
    """The same trees level by level, each level grouped by its parents; good for 16 ** ``levels`` rows a source."""

    def framed(value: str) -> str:
        return f"case when {value} is null then '-' else concat(strlen(cast({value} as varchar)), ':', {value}) end"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(map(framed, ("doc_id", "source", "lang", "n_chars", text))) + "))"

    def tree(name: str, start: str) -> str:
        found = f"{name}0 as ({start})"
        for k in range(levels):
            below = f"{name}{k}"
            found += f""", {below}s as (select *, count(*) over (partition by tree) as n, list(digest) over (partition by tree, idx // 16 order by idx rows between unbounded preceding and unbounded following) as run from {below}),
            {name}{k + 1} as (select tree, idx // 16 as idx, case when any_value(n) > 1 then sha256(string_agg(digest, '' order by idx)) else any_value(digest) end as digest from {below}s group by tree, idx // 16)"""
        return found

    def climbed(name: str, rows: str, tree: str, idx: str, given: list[str]) -> str:
        """``rows`` with a list of siblings appended to s and the digests in ``given`` folded, through all levels of a tree."""
        found, before = "", rows
        for k in range(levels):
            at = f"({idx} // {16**k})"
            ahead, behind = (f"coalesce(list_aggregate(list_slice(run, {a}, {b}), 'string_agg', ''), '')" for a, b in (("1", f"{at} % 16"), (f"{at} % 16 + 2", "16")))
            news = ", ".join(f"case when n > 1 then sha256(concat({ahead}, d.{c}, {behind})) else d.{c} end as {c}" for c in given)
            found += f", {name}{k} as (select d.* exclude (s, {', '.join(given)}), d.s || case when n > 1 then concat({ahead}, {behind}) else '' end as s, {news} from {before} d join {tree}{k}s x on x.tree is not distinct from d.{'source' if tree == 'a' else 'zero'} and x.idx = {at})"
            before = f"{name}{k}"
        return found

    raw = "list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda i: cast(ord(cast(doc_id as varchar)[i]) as bigint))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    chosen = f"doc_id is not null and {_crc32(raw)} % 5 = 0"
    return (
        f"with {_CRC}, leaves as (select doc_id, source, {leaf('text')} as leaf, case when {chosen} then {leaf(lower)} else {leaf('text')} end as changed from documents, steps), "
        + "placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx from leaves), "
        + tree("a", "select source as tree, idx, leaf as digest from placed")
        + f", tops as (select tree as source, row_number() over (order by tree nulls first) - 1 as place, digest as subroot from a{levels}), "
        + tree("b", "select 0 as tree, place as idx, subroot as digest from tops")
        + ", begun as (select doc_id, source, leaf, idx, changed as folded_root, '' as s from placed)"
        + climbed("c", "begun", "a", "d.idx", ["folded_root"])
        + f", joined as (select c.*, t.place, t.subroot, 0 as zero from c{levels - 1} c join tops t on c.source is not distinct from t.source)"
        + climbed("e", "joined", "b", "d.place", ["folded_root"])
        + f" select doc_id, leaf, subroot, r.digest as root, sha256(s) as proof_sha256, folded_root, folded_root = r.digest as verified from e{levels - 1}, b{levels} r"
    )


def _spelling_sql() -> str:
    """Near words by what is left of both without one letter, or with one letter blotted out."""
    bytes_ = "flatten(list_transform(range(1, length(s) + 1), lambda i: case when ord(s[i]) < 128 then [cast(ord(s[i]) as bigint)] else [cast(192 + (ord(s[i]) >> 6) as bigint), cast(128 + (ord(s[i]) & 63) as bigint)] end))"
    best = "row_number() over (partition by p.a order by w.n desc, p.b) as k, count(*) over (partition by p.a) as near"
    return (
        f"with recursive {_CRC}, lowered as (select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents), "
        "runs as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) as w from lowered) where length(w) >= 7 group by 1, 2), "
        f"hashed as (select w, n, {_crc32(bytes_)} as h from (select *, concat(doc_id, ':', w) as s from runs), steps), "
        "kept as (select case when h % 31 = 0 then concat(substr(w, 1, cast(h % length(w) as int)), substr(w, cast(h % length(w) as int) + 2)) else w end as word, n from hashed), "
        "words as (select word, cast(sum(n) as bigint) as n from kept where length(word) >= 7 group by 1 having sum(n) >= 2), "
        "cut as (select word, unnest(range(1, length(word) + 1)) as i from words), "
        "less as (select distinct word, concat(substr(word, 1, cast(i as int) - 1), substr(word, cast(i as int) + 1)) as part from cut), "
        "blot as (select word, concat(substr(word, 1, cast(i as int) - 1), '*', substr(word, cast(i as int) + 1)) as part from cut), "
        "one as (select l.word as a, w.word as b from less l join words w on w.word = l.part), "
        "pairs as (select a, b from one union select b, a from one union select x.word, y.word from blot x join blot y on x.part = y.part and x.word <> y.word), "
        f"ranked as (select p.a, p.b, w.n as form_n, {best} from pairs p join words w on w.word = p.b), "
        "found as (select w.word, case when r.form_n >= 10 * w.n then r.b end as form, w.n, coalesce(r.near, 0) as n_near, case when r.form_n >= 10 * w.n then r.form_n end as form_n from words w left join ranked r on r.a = w.word and r.k = 1), "
        "walk as (select word, word as root, 0 as step from found union all select walk.word, f.form, step + 1 from walk join found f on f.word = walk.root where f.form is not null) "
        "select f.word, form, root, n, n_near, form_n from found f join (select word, arg_max(root, step) as root from walk group by word) r on r.word = f.word"
    )


ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": _spelling_sql(), "op13_merkle_manifest": _merkle_sql()}
