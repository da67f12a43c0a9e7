"""Session helpers shared by all operators: table access, lineage cuts, salted joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows spread over all cores where its files give work to no more than a quarter of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._millrace_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, but only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not (own := spark.conf.get("millrace.shared.dir", None)):
        own = "file://" + tempfile.mkdtemp(prefix="spark-millrace-")
        spark.conf.set("millrace.shared.dir", own)
    return own


def own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"


def clear_own(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder; DataFrames that read it can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_directory(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result is read several times or where lineage must be cut: the written table
    outlives lost executors, which a cache or a local checkpoint would not.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of an equi-join that Spark must not broadcast.

    Spark judges by the size of files and by guesses about what is unfolded from them, and a broadcast is built in the driver's
    memory; where a side grows with the input and has been compressed or exploded, that is many times what it was taken for.
    """
    return df.hint("merge")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join for keys of which one may hold a large part of ``big``.

    Rows of ``big`` are spread over ``salts`` sub-keys by a hash of the whole row; ``small`` must
    have few rows a key and is repeated once a sub-key.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
