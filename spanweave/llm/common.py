"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word contracts have it.
WORD = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, also without regard to case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (a test session) a
    fresh temporary folder is set instead; on a cluster that would be a folder of
    one machine, so an error is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage,
    and a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/spanweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # shuffle files of finished steps go when the driver drops what refers to them
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast (some tens of MB); beyond, joins shuffle.
MOST_ROWS = 1_000_000


def sized(table: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast in a join if it was counted to be small."""
    return F.broadcast(table) if table.count() <= most else table


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote."""
    spark = df.sparkSession
    root = scratch_dir(spark)
    jvm = spark._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/spanweave-" in name and name.split("/spanweave-")[0].rstrip("/").endswith(root.split("://")[-1]):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(links: DataFrame) -> DataFrame:
    """Components of an undirected graph by distributed union-find.

    ``links`` has columns ``a`` and ``b`` of one orderable type.  Returns
    ``node, root`` for every node in a link between two different nodes, where
    ``root`` is the smallest node of the component.  Links with a null end and
    self links are ignored.

    Rounds of large-star and small-star contraction: each round hangs the
    larger neighbours of a node on its smallest neighbour and then the smaller
    ones, until no link changes.  Only the per-node minimum is aggregated (with
    map-side combine); no neighbourhood is ever gathered in one task, and both
    sides of each join come from written tables, so that a hub's rows can be
    split by the adaptive skew join.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("w", "v")).toDF("v", "w")
        low = materialize(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("m")))
        large = both.where("w > v").join(low, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).distinct()
        large = materialize(large)
        small_low = materialize(large.groupBy("v").agg(F.min("w").alias("m")))
        joined = large.join(small_low, "v")
        small = joined.select("v", F.col("m").alias("w")).union(
            joined.where("w <> m").select(F.col("w").alias("v"), F.col("m").alias("w"))
        )
        nxt = materialize(small.distinct())
        for t in (edges, low, large, small_low):
            drop_materialized(t)
        edges = nxt
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("v").alias("node"), F.col("w").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
