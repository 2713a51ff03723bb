"""Small files that are read on the driver: trees, substitution matrices, run configurations."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def branches(newick: str) -> dict[str, float]:
    """Branch lengths of a Newick tree by name; inner nodes without a name are named by their leaves, joined by dashes."""
    tokens = re.findall(r"[(),;]|[^(),;]+", newick.strip())
    found: dict[str, float] = {}
    stack: list[list[str]] = [[]]
    closed: list[str] | None = None
    for t in tokens:
        t = t.strip()
        if t == "(":
            stack.append([])
        elif t == ")":
            closed = stack.pop()
            stack[-1] += closed
            pending = "-".join(closed)
            found.setdefault(pending, 0.0)
        elif t in (",", ";", ""):
            closed = None
        else:
            name, _, length = t.partition(":")
            if closed is not None:
                key = "-".join(closed)
                if name:
                    found[name] = found.pop(key, 0.0)
                    key = name
                found[key] = float(length or 0)
                closed = None
            else:
                stack[-1].append(name)
                found[name] = float(length or 0)
    return found


def tree(spark: SparkSession, newick: str) -> DataFrame:
    return spark.createDataFrame(list(branches(newick).items()), "branch string, length double")


def group_length(tree: DataFrame, part: str | None = None) -> DataFrame:
    """Summed branch length, of all branches or of those whose names hold ``part``."""
    return (tree if part is None else tree.where(F.col("branch").contains(part))).agg(F.sum("length").alias("length"))


def mean_tree(trees: DataFrame, weight: str) -> DataFrame:
    """Mean branch lengths of many trees (branch, length, weight), weighted by the places that each stands for."""
    return trees.groupBy("branch").agg((F.sum(F.col("length") * F.col(weight)) / F.sum(weight)).alias("length"))


def matrices(text: str) -> list[tuple[str, str, str, float]]:
    """(branch, from, to, count) of expected substitution counts: blocks with a line ``Branch ... 'name'``, a line of states, rows."""
    out, branch, states = [], None, None
    for line in text.splitlines():
        if m := re.search(r"[Bb]ranch.*?['\"(]?([\w.-]+)['\")]?\s*:?\s*$", line):
            branch, states = m[1], None
        elif branch and states is None and line.split() and all(re.fullmatch(r"[ACGT]+", s) for s in line.split()):
            states = line.split()
        elif branch and states and (f := line.split()) and f[0] in states and len(f) == len(states) + 1:
            out += [(branch, f[0], s, float(x)) for s, x in zip(states, f[1:])]
    return out


def substitutions(counts: DataFrame, by: list[str] = ["branch"]) -> DataFrame:
    """Places, substitutions, those outside CpG contexts, and those that gene conversion doesn't favour, per branch, from (from, to, count) with
    states of two bases: each place is counted in two overlapping pairs, so sums of changes are halved."""
    a, b, n = F.col("from"), F.col("to"), F.col("count")
    changed = a != b
    cpg = a.contains("CG") | b.contains("CG")
    weak, strong = F.array(F.lit("A"), F.lit("T")), F.array(F.lit("C"), F.lit("G"))
    x, y = F.substring(a, 2, 1), F.substring(b, 2, 1)
    same_class = (F.array_contains(weak, x) & F.array_contains(weak, y)) | (F.array_contains(strong, x) & F.array_contains(strong, y))

    def total(condition):
        return F.sum(F.when(condition, n).otherwise(0.0))

    return counts.groupBy(*by).agg(F.sum(n).alias("bases"), (total(changed) / 2).alias("subs"), (total(changed & ~cpg) / 2).alias("non_cpg"), (total(changed & same_class & (F.substring(a, 1, 1) == F.substring(b, 1, 1)))).alias("non_bgc"))


def rates_by_context(conserved: DataFrame, neutral: DataFrame, by: list[str] = ["from", "to"]) -> DataFrame:
    """Ratio of row-normalised counts of two matrices (from, to, count)."""
    from pyspark.sql import Window

    def normal(df: DataFrame, name: str) -> DataFrame:
        rows = df.groupBy(*by).agg(F.sum("count").alias("c"))
        return rows.select(*by, (F.col("c") / F.sum("c").over(Window.partitionBy("from"))).alias(name))

    both = normal(conserved, "conserved").join(normal(neutral, "neutral"), by)
    return both.withColumn("ratio", F.col("conserved") / F.col("neutral"))


@dataclass(frozen=True)
class RunConfig:
    """What a run needs; kept as JSON and never evaluated."""

    chroms: tuple[str, ...] = tuple(f"chr{k}" for k in range(1, 23))
    coefficients: tuple[float, ...] = (10**-4.5, 10**-4.0, 10**-3.5, 10**-3.0, 10**-2.5, 10**-2.0)
    b_annotations: tuple[str, ...] = ()
    c_annotations: tuple[str, ...] = ()
    scale: int = 100
    least_b: float = 1e-5
    window: int = 1_000_000
    extra: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str) -> "RunConfig":
        found = json.loads(Path(path).read_text())
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in cls.__dataclass_fields__}
        return cls(**known)

    def parameters(self) -> int:
        return (len(self.b_annotations) + len(self.c_annotations)) * len(self.coefficients) + 1
