"""Helpers shared by the operators: reading tables, the shared folder, stored intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship


ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``. Whole texts go to Python workers in small batches, unless the session says otherwise."""
    ship(spark)
    if spark.conf.get(ARROW) == "10000":  # Spark's own value
        spark.conf.set(ARROW, ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only where none is set, as in tests."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if own is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledger-checkpoint-"))
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(own)
    return own or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the reliable checkpoint folder and cuts its lineage; lost executors can't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


HEAVY = 100_000  # edges of a node that one task may take: 1.6 MB
EDGES = 10_000  # of a task, at least: each task of each round leaves shuffle files and a log behind, however few edges it has


def _by_node(edges: DataFrame, n: int) -> DataFrame:
    """``edges(u, v)`` with ``m``, the smallest of ``u`` and all its ``v``. Of more than ``HEAVY`` edges the nodes with the most of them, a
    bounded number as each has a fixed share of all ``n`` edges or more, are met by broadcast, so that no task takes all edges of a hub."""
    if n <= HEAVY:
        met = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        heavy = F.col("degree") > max(HEAVY, n // 50_000)  # 100,000 nodes at most
        hubs = F.broadcast(cut(least.where(heavy).select("u", "m")))
        rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(~heavy).select("u", "m"), "u")
        met = edges.join(hubs, "u").unionByName(rest)
    return _few(met.select("u", "v", F.least("m", "u").alias("m")), n)


def _few(edges: DataFrame, n: int) -> DataFrame:
    """About ``n`` edges in one task for each ``EDGES`` of them at most; nothing is moved for it."""
    return edges.coalesce(1 + n // EDGES)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs, any direction, self-loops ignored): ``node, component`` with the
    smallest node of each component, for every node that has an edge. Alternates large-star and small-star steps
    (Kiveris et al., "Connected Components in MapReduce and Beyond"), each a grouped minimum, until the edges stop
    changing; every edge list is checkpointed, and only two numbers a round reach the driver. The number of tasks follows
    that of the edges, as a round over few edges in as many tasks as the whole table has leaves more files than data."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    pairs = lambda x, *of: x.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in of))).alias("x")).select("x.u", "x.v")
    before = state(e)
    e = _few(e, before[0])
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: every neighbour above u links to the smallest of u and its neighbours
        large = _by_node(pairs(e, "uv", "vu"), before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: every neighbour below u, and u itself, links to the smallest of them
        e = cut(_few(pairs(_by_node(large, before[0]), "vm", "um").where("u <> v").distinct(), before[0]))
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    own = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(_few(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), before[0]))


def all_of(*conditions):
    return reduce(lambda a, b: a & b, conditions)


def clear_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores appended until no column of ``df`` has that name in any case."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted
