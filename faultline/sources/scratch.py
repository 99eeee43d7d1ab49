"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of intermediate tables begin so; release() deletes no others.
PREFIX = "faultline-"
#: Folders made within each open scratch().
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir.

    Only a local session (tests, notebooks) may leave the folder unnamed; on a cluster a local
    folder would differ from machine to machine, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/{PREFIX}{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, never a new
    evaluation that could number rows in another way.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    for made in _OPEN:
        made.append(path)
    df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._faultline_stored = True
    return got


def stored(df: DataFrame) -> DataFrame:
    """df itself if it is what materialize has returned, else what materialize makes of it."""
    return df if "_faultline_stored" in vars(df) else materialize(df)


def release(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            if folder.rsplit("/", 1)[1].startswith(PREFIX):
                _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all intermediate tables that were written within, also those that operators have made for their results.

    Write what is wanted of a result before the end: `with scratch(spark): operator(rows).write.parquet(path)`.
    """
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for folder in made:
            _delete(spark, folder)
