"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each category's logistic model sees the words of the text and the
probabilities of the categories before it. For training, these probabilities are out-of-fold: each row's come from models
that were fitted without its fold; so later models learn from predictions as good as those they will get. Labels hold one
toxicity flag only, so the finer categories are learned: the toxic rows are clustered by their features into ``kinds`` groups,
and being of a group is a category that comes before the flag itself. No list of words is given.

Models are fitted on a bounded sample of the labelled rows (``sample`` rows, by a hash of their id); its word counts are
summed by Spark, and only the chosen words' places in each sampled row come to the driver. All texts are scored in tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import saved, map_texts, slices

_WORD = re.compile(r"[^\W\d_]+")
def features(text: str | None) -> set[str]:
    """Distinct words in lower case, and the first five letters of the longer ones, marked with a star."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:5] + "*" for w in words if len(w) > 5}


@dataclass(frozen=True)
class Chain:
    """Fitted models: the features, and for each category weights of features, of earlier probabilities, and a bias; and the
    probability of the last category from which a text counts as toxic."""

    categories: tuple[str, ...]
    place: dict[str, int]
    weights: np.ndarray
    earlier: np.ndarray
    bias: np.ndarray
    threshold: float

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category; zero for texts without words."""
        known, out = self.place.keys(), np.zeros((len(texts), len(self.categories)))
        for i, text in enumerate(texts):
            own = features(text)
            if not own:
                continue
            found = [self.place[w] for w in known & own]
            score = self.weights[:, found].sum(axis=1) + self.bias
            for k in range(len(self.categories)):
                out[i, k] = _sigmoid(score[k] + self.earlier[k, :k] @ out[i, :k])
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Rows:
    """Rows of present features, as one flat array of places; with dense columns beside."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray, width: int):
        self.flat, self.lengths, self.width, self.row = flat, lengths, width, np.repeat(np.arange(len(lengths)), lengths)

    def some(self, keep: np.ndarray) -> "_Rows":
        return _Rows(self.flat[keep[self.row]], self.lengths[keep], self.width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.lengths))

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, r[self.row], self.width)


def _kinds(x: _Rows, kinds: int, rounds: int = 25) -> np.ndarray:
    """The group, from 0 to ``kinds`` - 1, of each row: spherical k-means, from rows far from each other."""
    size = np.sqrt(np.maximum(x.lengths, 1))

    def likeness(center: np.ndarray) -> np.ndarray:
        return x.times(center / max(np.linalg.norm(center), 1e-12)) / size

    def center(rows: np.ndarray) -> np.ndarray:
        return x.back(rows / size)

    n = len(x.lengths)
    if n < kinds:
        return np.zeros(n, np.int64)
    nearest = likeness(center(np.ones(n)))
    seeds = []
    for _ in range(kinds):
        seeds.append(center((np.arange(n) == nearest.argmin()).astype(float)))
        nearest = np.maximum(nearest if len(seeds) > 1 else 0, likeness(seeds[-1]))
    group = np.zeros(n, np.int64)
    for _ in range(rounds):
        before, group = group, np.argmax([likeness(s) for s in seeds], axis=0)
        seeds = [center((group == k).astype(float)) if (group == k).any() else s for k, s in enumerate(seeds)]
        if (before == group).all():
            break
    return group


def _fit(x: _Rows, dense: np.ndarray, y: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by Adam over all rows, each with the same weight."""
    theta = np.zeros(x.width + dense.shape[1] + 1)
    if not y.size or y.min() == y.max():  # one class only: always that class
        theta[-1] = 30 if y.size and y[0] else -30
        return theta[: x.width], theta[x.width : -1], theta[-1]
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        p = _sigmoid(x.times(theta[: x.width]) + dense @ theta[x.width : -1] + theta[-1])
        r = (p - y) / len(y)
        g = np.concatenate([x.back(r), dense.T @ r, [r.sum()]])
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.3 / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[: x.width], theta[x.width : -1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, vocabulary: int = 4096, significance: float = 7.0, kinds: int = 2, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit the chain on at most ``sample`` labelled rows and ``vocabulary`` features, those whose shares among toxic and clean rows
    differ by at least ``significance`` standard errors, or 0.7 of the most that so few rows can show. ``kinds``: learned categories
    before the last (0: the last model alone). Null labels, ids and texts don't train; without rows of both classes nothing is toxic."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = saved(texts.join(F.broadcast(known), "id"))  # `sample` rows of 12 bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Counter(), Counter()
        for batch in slices(batches):
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by[bool(y)].update(features(text))
        words = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in by)], ["word", "n0", "n1"])

    sums = rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    n1, n0 = sums.n1 or 0, sums.n - (sums.n1 or 0)
    p1, p0 = (F.col("n1") + 0.5) / (n1 + 1.0), (F.col("n0") + 0.5) / (n0 + 1.0)
    both = (F.col("n0") + F.col("n1")) / float(max(1, sums.n))
    counted = map_texts(rows, count, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    z = F.abs(p1 - p0) / F.sqrt(both * (1.0001 - both) * (1 / (n1 + 1) + 1 / (n0 + 1)))  # of the difference of two shares
    enough = min(significance, 0.7 * sums.n**0.5)  # a word in all toxic and no clean rows has about the root of the rows
    chosen = counted.select("word", z.alias("z")).where(F.col("z") >= enough).orderBy(F.desc("z"), "word").limit(vocabulary)
    place = {w: i for i, w in enumerate(r.word for r in chosen.select("word").collect())}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = place.keys()
        for batch in slices(batches):
            found = [sorted(place[w] for w in known & features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["id", "y", "places"])

    kind = rows.schema["id"].dataType.simpleString()
    marked = map_texts(rows, mark, f"id {kind}, y int, places array<int>").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)))
    local = marked.orderBy(F.xxhash64("id"), "id").select("y", "places", "fold").toArrow().combine_chunks()
    y, fold = (np.asarray(local[c].to_pylist(), np.int64) for c in ("y", "fold"))
    places = local["places"].combine_chunks() if len(local) else pa.array([], pa.list_(pa.int32()))
    places = places.combine_chunks() if isinstance(places, pa.ChunkedArray) else places
    x = _Rows(places.flatten().to_numpy().astype(np.int64), places.value_lengths().to_numpy().astype(np.int64), max(1, len(place)))
    group = np.full(len(y), -1)
    group[y == 1] = _kinds(x.some(y == 1), max(kinds, 1))
    categories = (*(f"kind_{k + 1}" for k in range(kinds)), label_col)
    weights, earlier, bias = np.zeros((len(categories), x.width)), np.zeros((len(categories), len(categories))), np.zeros(len(categories))
    before = np.zeros((len(y), 0))
    for k in range(len(categories)):
        target = (y == 1 if k == kinds else group == k).astype(float)
        weights[k], earlier[k, :k], bias[k] = _fit(x, before, target)
        out = np.zeros(len(y))
        for f in range(folds):
            own = fold == f
            w, d, b = _fit(x.some(~own), before[~own], target[~own])
            out[own] = _sigmoid(x.some(own).times(w) + before[own] @ d + b)
        before = np.column_stack([before, out])
    clean = before[y == 0, -1]
    # Out of fold, about one clean row in a thousand would be taken for toxic.
    threshold = float(np.clip(np.quantile(clean, 0.999) if len(clean) else 0.5, 0.2, 0.8))
    return Chain(categories, place, weights, earlier, bias, threshold)


def score(docs: DataFrame, chain: Chain, threshold: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, p_<category> for each, ``toxic``), a row for each row of ``docs``, in no order.

    Texts without words, null and empty ones among them, have probability zero and are never toxic. ids may be null or repeated.
    Other columns, whatever their names, are left out. ``toxic``: the last category's probability is at least ``threshold`` (not given: the chain's).
    """
    names = [f"p_{c}" for c in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # `vocabulary` words and their weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in p.T)], ["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    return scored.select(F.col("id").alias(id_col), *names, (F.col(names[-1]) >= (chain.threshold if threshold is None else threshold)).alias("toxic"))


def without_toxic(docs: DataFrame, chain: Chain, threshold: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns."""
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(chain)
    least = chain.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.predict(batch.column(place).to_pylist())[:, -1] < least))

    return map_texts(docs, run, docs.schema)
