"""Tables that a plan writes once and reads where it needs them."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame


#: Seconds between two clean-ups of shuffle files.
CLEAN_SECONDS = 5.0
_cleaned = [0.0]


def written(df: DataFrame) -> DataFrame:
    """Write to the folder in ``spark.checkpoint.dir`` and read back.

    What was shuffled for it isn't needed any more; the driver lets go of it, at most
    every :data:`CLEAN_SECONDS`, so that a query of many steps holds one step's files.
    Only a local session may lack the setting; a folder of one machine is of no
    use to a cluster.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if time.monotonic() - _cleaned[0] >= CLEAN_SECONDS:
        gc.collect()
        spark._jvm.System.gc()
        _cleaned[0] = time.monotonic()
    return spark.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` gave and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if name.rsplit("/", 1)[1].startswith("round-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
