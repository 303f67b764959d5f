"""The folder that driver and executors share, and lineage cuts through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset a
    folder is chosen here: a temporary one if everything runs in one process,
    and one below the warehouse otherwise.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root is None:
        root = getattr(sc, "_own_shared_root", None)
    if root is None:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="shared-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        sc._own_shared_root = root
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, computed once, written as Parquet in the shared folder and read from there.

    Unlike checkpoint() this runs the plan once, is compressed, and lets later
    plans read only the columns they need.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote; no table that is still to be read may stand on them."""
    for made in tables:
        jvm = made.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(made._cut_path)
        path.getFileSystem(made.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
