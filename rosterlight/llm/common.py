"""Helpers that the operators of this subpackage share: storage, column safety, tables of a run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the one set as checkpoint folder.

    Only a local master, where all share one machine, may do without: a new local folder is made then.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rosterlight-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back: the lineage ends there, and a lost executor costs no more than a read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table that ``stored`` wrote for ``df``, once nothing reads it any more."""
    deleted(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def clear(spark: SparkSession) -> None:
    """Deletes every step that this process has stored.  For the end of a run: results not yet written need their steps."""
    deleted(spark, list(_WRITTEN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def making_room(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its own columns of these names renamed, so that they can be added."""
    for name in names:
        for own in [c for c in df.columns if c.lower() == name.lower()]:
            df = df.withColumnRenamed(own, free_name(df, own + "_"))
    return df


def apart(key: Column) -> Column:
    """Always 0, to group by beside ``key``: what is grouped by both is dealt anew in a join on ``key`` alone, and only a side
    that is dealt anew lets adaptive execution split the other side's hot keys."""
    return F.pmod(F.xxhash64(key), F.lit(1)).alias("apart_")
