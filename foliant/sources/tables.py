"""Access to the Parquet tables of one directory, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout elements, one row for each ``(page_id, elem_idx)``.

    An element may be delivered more than once; the delivery that arrived first is kept,
    ties are equal in every other column.
    """
    from pyspark.sql import functions as F

    e = table(spark, sf_dir, "page_element")
    rest = [c for c in e.columns if c not in ("page_id", "elem_idx")]
    return (
        e.groupBy("page_id", "elem_idx")
        .agg(F.min_by(F.struct(*rest), F.coalesce("arrived_at", F.lit("9999-01-01").cast("timestamp"))).alias("r"))
        .select("page_id", "elem_idx", "r.*")
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once as a table in the shared checkpoint folder, with the lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs on one machine,
    as in tests, a temporary folder is used.
    """
    spark = df.sparkSession
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp()
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
