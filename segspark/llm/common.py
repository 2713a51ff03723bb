"""Shared pieces: reading tables, tables in the shared folder, bounded batches of texts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scopes: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A local session without one gets a temporary folder; a cluster is an error,
    as a folder of one machine can't be read by the others."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="shared")
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def new_folder(spark: SparkSession) -> str:
    inside = _scopes[-1] if _scopes else f"{shared_folder(spark)}/segspark-{spark.sparkContext.applicationId}"
    return f"{inside}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application saved. DataFrames returned earlier can't be read any more."""
    remove(spark, f"{shared_folder(spark)}/segspark-{spark.sparkContext.applicationId}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are removed at the end; what is to stay must have been written elsewhere by then."""
    folder = new_folder(spark)
    _scopes.append(folder)
    try:
        yield
    finally:
        _scopes.remove(folder)
        remove(spark, folder)


def saved(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: its lineage is cut, and a lost executor costs nothing that
    came before. The table stays until its ``scratch`` ends or ``clear``."""
    folder = folder or new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow``; Spark bounds its batches by ``spark.sql.execution.arrow.maxBytesPerBatch`` as well as by rows."""
    return rows.mapInArrow(run, schema)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and about ``size`` bytes (or one row), so that what a task builds from one
    batch stays small."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and (part.num_rows > rows or part.get_total_buffer_size() > size and part.nbytes > size):
                half = min(rows, (part.num_rows + 1) // 2)
                waiting += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected links, as (node, component); component is the least node that can be reached.

    ``links`` has two long columns, whatever their names; loops, repeats and nulls are ignored. Nodes without links to other
    nodes are not returned. Alternating large-star and small-star steps: every step is a grouped minimum and a join back, so
    no neighbourhood is ever gathered; each round is saved, and the one before removed. Stops when the edges no longer change.
    """
    spark, (a, b) = links.sparkSession, links.columns
    folder = new_folder(spark)
    edges, before = saved(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), folder), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        past, folder = folder, new_folder(spark)
        edges = saved(small, folder)
        remove(spark, past)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
