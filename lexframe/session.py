"""Session helpers shared by every operator: table access and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: one of this application's own under the one named in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests) a local one is chosen, once per
    context; on a cluster it must be set. What is in it goes when the application ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local") or named is None and sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexframe-ckpt-"))
    at = sc.getCheckpointDir()
    folder = sc._jvm.org.apache.hadoop.fs.Path(at)  # noqa: SLF001
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)  # noqa: SLF001
    return at.removeprefix("file:").replace("///", "/") if at.startswith("file:") else at


_kept: dict[tuple, tuple] = {}


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at  # noqa: SLF001


def kept(spark: SparkSession, sf_dir: str, name: str, sources: tuple[str, ...], make: Callable[[], object]) -> object:
    """What ``make`` gives, made once per application and state of the source tables, as a pack is compiled once and then queried.

    It is made anew when a source changes or when its files are gone.
    """
    stamps = []
    for t in sources:
        fs, at = _hadoop(spark, f"{sf_dir}/{t}.parquet")
        stamps += [(f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(at)]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _kept:
        known, value, files = _kept[key]
        if known == stamps and all(fs.exists(at) for fs, at in (_hadoop(spark, f) for f in files)):
            return value
    value = make()
    _kept[key] = (stamps, value, value.inputFiles()[:1] if isinstance(value, DataFrame) else [value] if isinstance(value, str) else [])
    return value


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors lose no work."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder as a table and read from there: smaller than a checkpoint, and columns are read singly. by: columns of few values to partition it by."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
