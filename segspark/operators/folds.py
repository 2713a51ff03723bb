"""Folds along an axis whose every decision depends on the row kept last, without a task for a whole key.

A key's axis is cut into buckets. What a bucket does to any state that can come into it is tabulated by the bucket itself, in one
short table: which of its rows would be kept first, and what would be kept last. One group a key then runs through these tables, not the
rows, and finds the state each bucket begins with; each bucket keeps its rows from there. Three shuffles, whatever the
number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.operators import scan

State = tuple | None


def _carried(rows: DataFrame, by: list[str], table: Callable, entries: str, advance: Callable, run: Callable, schema: str, order: list[str]) -> DataFrame:
    """``rows`` have a bucket __b. ``table(pdf, bucket)`` gives a bucket's entries; ``advance(state, entries)`` the state behind it (a tuple of
    floats or None, also the first state); ``run(pdf, state, bucket)`` its results. Behind the last bucket with entries ``run`` gets the last state."""
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    names = [*by, "__b", *[e.split()[0] for e in entries.split(", ")]]

    def tables(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = table(pdf.sort_values(order, kind="stable", ignore_index=True), int(key[-1]))
        return pd.DataFrame([(*key, *row) for row in found], columns=names)

    def states(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = None, []
        for b, part in pdf.groupby("__b", sort=True):
            out.append((*key, b, None if state is None else list(state)))
            state = advance(state, part)
        out.append((*key, pdf["__b"].max() + 1, None if state is None else list(state)))
        return pd.DataFrame(out, columns=[*by, "__b", "__state"])

    def results(key: tuple, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        state = before["__state"].iloc[0] if len(before) else None
        return run(key, pdf.sort_values(order, kind="stable", ignore_index=True), None if state is None else tuple(state))

    tabled = rows.groupBy(*by, "__b").applyInPandas(tables, f"{keys}, __b long, {entries}")
    known = tabled.groupBy(*by).applyInPandas(states, f"{keys}, __b long, __state array<double>")
    return rows.groupBy(*by, "__b").cogroup(known.groupBy(*by, "__b")).applyInPandas(results, schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _last(follow: Callable[[int], int | None], nodes: int, first: int, ends: np.ndarray) -> int:
    """The last node of the chain from ``first``; ``ends`` (-1: unknown) remembers it for all nodes on the way."""
    path, node = [], first
    while node is not None and ends[node] < 0:
        path.append(node)
        node = follow(node)
    end = path[-1] if node is None else ends[node]
    ends[path] = end
    return int(end)


def spaced(rows: DataFrame, least: int, by: list[str] = ["chrom"], pos: str = "pos") -> DataFrame:
    """The first row of each key, and each that lies at least ``least`` (1 or more) past the last one kept. Of rows at one place the least by the other
    columns counts; rows without a key or place are left out. A key's group holds a row for each of the places that open its
    buckets of 1,024 times ``least`` (2^20 at the least), about a thousandth of the places or fewer where places are spread evenly."""
    width, columns = max(1 << 20, 1024 * least), rows.columns
    rest = [c for c in columns if c not in (*by, pos)]
    known = rows.where(" and ".join(f"`{c}` is not null" for c in (*by, pos)))
    once = known.groupBy(*by, pos).agg(F.min(F.struct(*[F.col(c) for c in rest] or [F.lit(0).alias("__0")])).alias("__r"))
    once = once.select(*[F.col(c) if c in (*by, pos) else F.col(f"__r.`{c}`").alias(c) for c in rows.columns]).withColumn("__b", F.floor(F.col(pos) / F.lit(width)).cast("long"))

    def table(pdf: pd.DataFrame, b: int) -> Iterator[tuple]:
        at = pdf[pos].to_numpy()
        after, ends = np.searchsorted(at, at + least), np.full(len(at), -1)
        for k in range(min(int(after[0]) + 1, len(at))):  # all rows that can be kept first: what is kept before lies before the bucket
            yield int(at[k]), int(at[_last(lambda i: int(after[i]) if after[i] < len(at) else None, len(at), k, ends)])

    def advance(state: State, entries: pd.DataFrame) -> State:
        firsts = np.sort(entries["first"].to_numpy())
        k = 0 if state is None else int(np.searchsorted(firsts, state[0] + least))
        return state if k == len(firsts) else (float(entries["last"].to_numpy()[np.argsort(entries["first"].to_numpy())][k]),)

    def run(key: tuple, pdf: pd.DataFrame, state: State) -> pd.DataFrame:
        at, kept = pdf[pos].to_numpy(), []
        k = 0 if state is None else int(np.searchsorted(at, state[0] + least))
        while k < len(at):
            kept.append(k)
            k = int(np.searchsorted(at, at[k] + least))
        return pdf.iloc[kept][columns]

    return _carried(once, by, table, "first long, last long", advance, run, _schema(rows), [pos])


def changed(rows: DataFrame, share: float, value: str, by: list[str] = ["chrom"], pos: str = "pos", width: int = 1 << 20) -> DataFrame:
    """The first row of each key, and each whose value differs from that of the last one kept by more than ``share`` of it (from zero: at all).
    Places are distinct within a key; rows without a key, place or value (or with NaN) are left out. What a bucket keeps first is a new greatest or least
    value of it, so a key's group holds these records only: some tens a bucket where values go up and down, all rows where they only rise."""
    columns = rows.columns
    known = rows.where(" and ".join(f"`{c}` is not null" for c in (*by, pos, value)) + f" and not isnan(`{value}`)").withColumn("__b", F.floor(F.col(pos) / F.lit(width)).cast("long"))

    def differs(x: np.ndarray, held: float) -> np.ndarray:
        return (x != held) & ((held == 0) | (np.abs(x - held) > share * abs(held)))

    def following(x: np.ndarray, k: int, held: float, step: int = 1024) -> int | None:
        while k < len(x):  # piece by piece, as the next change is near as a rule
            hit = differs(x[k : k + step], held)
            if hit.any():
                return k + int(hit.argmax())
            k, step = k + step, step * 2
        return None

    def table(pdf: pd.DataFrame, b: int) -> Iterator[tuple]:
        x = pdf[value].to_numpy(dtype=np.float64)
        ends, top, low = np.full(len(x), -1), np.maximum.accumulate(x), np.minimum.accumulate(x)
        record = np.ones(len(x), bool)
        record[1:] = (x[1:] > top[:-1]) | (x[1:] < low[:-1])
        for k in np.flatnonzero(record):
            yield int(k), float(x[k]), float(x[_last(lambda i: following(x, i + 1, x[i]), len(x), int(k), ends)])

    def advance(state: State, entries: pd.DataFrame) -> State:
        entries = entries.sort_values("place")
        x = entries["first"].to_numpy()
        k = (0 if len(x) else None) if state is None else following(x, 0, state[0])
        return state if k is None else (float(entries["last"].to_numpy()[k]),)

    def run(key: tuple, pdf: pd.DataFrame, state: State) -> pd.DataFrame:
        x, kept = pdf[value].to_numpy(dtype=np.float64), []
        k = (0 if len(x) else None) if state is None else following(x, 0, state[0])
        while k is not None:
            kept.append(k)
            k = following(x, k + 1, x[k])
        return pdf.iloc[kept][columns]

    return _carried(known, by, table, "place long, first double, last double", advance, run, _schema(rows), [pos])


def _displacing(start: np.ndarray, length: np.ndarray, k: int, end: float, held: float) -> tuple[int, bool] | None:
    """Of rows from ``k`` on the first that begins at ``end`` or later, or is longer than ``held``; and whether it is the latter alone."""
    p = k + int(np.searchsorted(start[k:], end))
    longer = length[k:p] > held
    if longer.any():
        return k + int(longer.argmax()), True
    return (p, False) if p < len(start) else None


def longer_kept(features: DataFrame, by: list[str] = ["chrom"], width: int = 1 << 20) -> DataFrame:
    """Features (key, start, end, score), both ends included, without overlaps: in the order of start, end and score, one that begins before the
    end of the last one kept replaces it if it is longer, and is dropped if not; one that begins where the feature kept before that ends is cut by a place.

    A feature is dealt to the buckets that it reaches, so that each bucket knows the features open at its border: these, and none,
    are the states that can come in. A key's group holds a row for each of them. Features without a key, start, end or score, and those that end before
    they begin, are left out; repeated ones count once.
    """
    known = features.select(*by, F.col("start").cast("long"), F.col("end").cast("long"), F.col("score").cast("double"))
    known = known.where(" and ".join(f"`{c}` is not null" for c in (*by, "start", "end", "score")) + " and start <= end").distinct()
    own = F.floor(F.col("start") / F.lit(width)).cast("long")
    rows = known.withColumn("__b", F.explode(F.sequence(own, F.floor(F.col("end") / F.lit(width)).cast("long")))).withColumn("__open", F.col("__b") > own)
    schema, columns = _schema(known), known.columns

    def parted(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        inner = pdf[~pdf["__open"].astype(bool)]
        start, end = inner["start"].to_numpy(np.int64), inner["end"].to_numpy(np.int64)
        return start, end, end - start + 1, inner["score"].to_numpy(np.float64)

    def onward(start: np.ndarray, end: np.ndarray, length: np.ndarray, node: int) -> tuple[int, bool] | None:
        """A node is three times its row, plus 1 if the row was cut, 2 if the feature kept before ends where it begins. The next
        node, and whether it replaces this one."""
        k, mark = divmod(node, 3)
        found = _displacing(start, length, k + 1, end[k], length[k] - (mark == 1))
        if found is None:
            return None
        j, replaces = found
        return 3 * j + ((mark > 0 and start[j] == start[k]) if replaces else 2 * (end[k] == start[j])), replaces

    def entry(start: np.ndarray, length: np.ndarray, state: State) -> tuple[int, bool] | None:
        if state is None:
            return (0, False) if len(start) else None
        found = _displacing(start, length, 0, state[1], state[1] - state[0] + 1)
        return found and (3 * found[0] + (0 if found[1] else 2 * int(state[1] == start[found[0]])), found[1])

    def table(pdf: pd.DataFrame, b: int) -> Iterator[tuple]:
        start, end, length, score = parted(pdf)
        if not len(start):
            return
        ends = np.full(3 * len(start), -1)

        def follow(node: int) -> int | None:
            found = onward(start, end, length, node)
            return found and int(found[0])

        states = {(int(s) + cut, int(e)) for s, e in pdf.loc[pdf["__open"].astype(bool), ["start", "end"]].itertuples(index=False) for cut in (0, 1)}
        for state in [None, *sorted(states)]:
            found = entry(start, length, state)
            if found is not None:
                k, mark = divmod(_last(follow, 3 * len(start), int(found[0]), ends), 3)
                yield (*(state or (None, None)), int(start[k]) + (mark == 1), int(end[k]), float(score[k]))
            else:
                yield (*state, None, None, None)

    def advance(state: State, entries: pd.DataFrame) -> State:
        hit = entries[(entries["from"] == state[0]) & (entries["to"] == state[1])] if state else entries[:0]
        hit = hit if len(hit) else entries[entries["from"].isna()]  # what was kept last ends before the bucket
        out = hit[["start", "end", "score"]].iloc[0]
        return state if out.isna().any() else tuple(float(x) for x in out)

    def run(key: tuple, pdf: pd.DataFrame, state: State) -> pd.DataFrame:
        start, end, length, score = parted(pdf)
        out, found = [], entry(start, length, state) if len(start) else None
        while found is not None:
            (k, mark), replaces = divmod(int(found[0]), 3), found[1]
            if state is not None and not replaces:
                out.append(state)
            state = int(start[k]) + (mark == 1), int(end[k]), float(score[k])
            found = onward(start, end, length, int(found[0]))
        if not len(start) and state is not None:  # behind the last bucket that features begin in
            out.append(state)
        return pd.DataFrame([(*key[:-1], int(s), int(e), x) for s, e, x in out], columns=columns)

    return _carried(rows, by, table, "from double, to double, start double, end double, score double", advance, run, schema, ["start", "end", "score"])


def rate_blocks(kept: DataFrame, lengths: DataFrame, scale: float = 1.0, by: list[str] = ["chrom"], width: int = 1 << 20) -> DataFrame:
    """Blocks (key, start, end, rate, r_start, r_end), both ends included, that tile each key from 1 to its length: features without overlaps
    with rate = score * ``scale``, and the gaps: before the first with its rate, between two with the mean of theirs, behind the last with its
    rate. r_start and r_end are the sums of the rates before a block's first and last place. ``lengths`` (key, length) has a row a key;
    keys without features have no blocks."""
    rows = kept.withColumn("rate", F.col("score") * scale).withColumn("__own", F.struct("end", "rate"))
    rows = scan.neighbour(rows, by, "start", "__own", "__p", width, ["end"])
    last = rows.groupBy(*by).agg(F.max_by(F.col("__own"), F.struct("start", "end")).alias("__l")).join(lengths.select(*by, "length"), by)
    before = F.coalesce(F.col("__p.end"), F.lit(0)) + 1
    gap = F.struct(before.alias("start"), (F.col("start") - 1).alias("end"), ((F.coalesce(F.col("__p.rate"), F.col("rate")) + F.col("rate")) / 2).alias("rate"))
    blocks = rows.select(*by, F.inline(F.array(gap, F.struct("start", "end", "rate"))))
    tail = last.select(*by, (F.col("__l.end") + 1).alias("start"), F.col("length").cast("long").alias("end"), F.col("__l.rate").alias("rate"))
    blocks = blocks.unionByName(tail).where("start <= end").withColumn("__n", (F.col("end") - F.col("start") + 1) * F.col("rate"))
    blocks = scan.prefix_sum(blocks, by, "start", {"__upto": "__n"}, width, ["end"])
    r_start = F.col("__upto") - F.col("__n")
    return blocks.select(*by, "start", "end", "rate", r_start.alias("r_start"), (r_start + (F.col("end") - F.col("start")) * F.col("rate")).alias("r_end"))
