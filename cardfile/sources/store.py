"""Tables and files in the folder that driver and executors share.

`spark.checkpoint.dir` names that folder on a cluster. It is read from the
session; only where it is unset on a local master (tests, a laptop) a temporary
one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="cardfile-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no one else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """`df` written once as Parquet to the shared folder and read again.

    Cuts the lineage: what comes later does not depend on the executors that
    made these rows, and shared inputs of several branches are made once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._cut_path = path
    return kept


def drop(df: DataFrame) -> None:
    """Deletes what `cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that its URI names."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that URI."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder of one file system; fails if it could not."""
    system, source = _file_system(spark, old)
    if not system.rename(source, _file_system(spark, new)[1]):
        raise OSError(f"could not rename {old} to {new}")


def replace_folder(df: DataFrame, path: str, form: str = "parquet", **options) -> None:
    """Writes df in place of what path holds, which df itself may read.

    The rows are written beside it first, so a write that fails leaves the old
    folder as it was. Then the old one is renamed away and the new one takes its
    name; if that fails the old one gets its name back.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    path = path.rstrip("/")
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    try:
        df.write.format(form).options(**options).save(new)
    except Exception:
        remove(spark, new)
        raise
    there = exists(spark, path)
    if there:
        move(spark, path, old)
    try:
        move(spark, new, path)
    except Exception:
        if there:
            move(spark, old, path)
        remove(spark, new)
        raise
    if there:
        remove(spark, old)


#: Rows that Spark hands to Python at once when they hold whole texts.
TEXT_ROWS = 1_000


def text_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches held to TEXT_ROWS rows.

    Spark's default of 10,000 rows is meant for narrow rows; of whole texts it
    is tens of MB, several times over in each Python worker.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    return df


def byte_batches(df: DataFrame, most: int) -> DataFrame:
    """df, with the session's Arrow batches held to about `most` bytes, as rows of a MB or more need."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    held = conf.get(name).rstrip("b")
    if not held.isdigit() or int(held) > most:
        conf.set(name, str(most))
    return df
