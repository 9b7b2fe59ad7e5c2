"""Session helpers shared by the operators: durable intermediate tables, table reading and column names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Small rows that one task writes.
ROWS_A_TASK = 250_000
#: Folders that this process has written tables to, by application; they go when it ends.
_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is missing a local run (driver and executors in one process, as in tests) gets a temporary
    folder; on a cluster that is an error, because executors do not share local folders.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set(_SETTING, folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    ``rows``: where a bound of its small rows is known, it is written by as few tasks as that needs, so that a small
    table is not dealt over as many files as the session has shuffle partitions.

    The written table cuts the lineage: when an executor is lost, later stages read files again instead of
    recomputing everything above. ``discard`` deletes it; what is left goes when the driver's process ends.
    """
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/tidewire/{spark.sparkContext.applicationId}"
    _WRITTEN.setdefault(home, spark)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df = df if rows is None else df.coalesce(max(1, min(shuffle_width(spark), -(-rows // ROWS_A_TASK))))
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads, recomputation included."""
    for t in tables:
        _delete(t.sparkSession, t._tidewire_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@atexit.register
def _clean() -> None:
    for home, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):  # the JVM may be gone; then the cluster's own cleaning is left
            _delete(spark, home)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        n = 0
        while (free := f"{name}_{n}" if n else name).lower() in taken:
            n += 1
        taken.add(free.lower())
        out.append(free)
    return out


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two longs that are equal for rows with the same id and text, and for no others but by a clash of 128 bits.

    The first one is the id itself, so that texts only meet under repeated ids; rows without id get a second hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    absent = F.when(F.col(text_col).isNull(), F.lit(1)).otherwise(F.lit(0))
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), text)), F.xxhash64(F.col(id_col).isNull(), absent, text)
