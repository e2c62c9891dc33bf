"""Tables written between the steps of one operator, in the folder that all executors share."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "vellumine-scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset a local one is made and set, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellumine-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{OWN_FOLDER}/{uuid.uuid4().hex}-{name}")
    return _made[-1]


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: a bare one is in the cluster's default file system, not on the machine that opens it."""
    p, fs = hadoop_path(spark, path)
    return fs.makeQualified(p).toString()


def drop(df: DataFrame) -> None:
    """Deletes the files of a table from ``written`` that no later plan reads."""
    if path := getattr(df, "_scratch_path", None):
        p, fs = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)


def made() -> int:
    """How many scratch paths this process has handed out; for ``drop_since``."""
    return len(_made)


def drop_since(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes what was made after the first ``since`` paths, but for the table ``keep``, which must not need the rest."""
    own = getattr(keep, "_scratch_path", None)
    for path in _made[since:]:
        if path != own:
            p, fs = hadoop_path(spark, path)
            fs.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all scratch tables; call it once all results have been written."""
    p, fs = hadoop_path(spark, f"{shared_dir(spark)}/{OWN_FOLDER}")
    fs.delete(p, True)
