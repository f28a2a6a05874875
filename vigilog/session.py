"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = 4 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results and speed depend on.

    Log times are rendered in UTC. Lists are gathered for very many small groups (chunks,
    batch groups), where sorting first beats a hash table that has to fall back to sorting.
    Batches for Python hold few bytes, however long documents and prompts are.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    # A model's reply may repeat a key; the last one counts, as in other JSON readers.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only in local mode:
    executors of a cluster would not see the driver's disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="vigilog-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Used where several branches read one expensive result: the branches then scan only
    the columns they need, and a lost executor costs a re-read rather than a recompute.
    """
    path = f"{scratch_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """The file system of a path as pyarrow sees it, for sessions without the JVM's (Connect)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    if hasattr(spark, "_jsc"):
        store, where = _hadoop(spark, path)
        found = store.listStatus(where) if store.exists(where) else []
        return sorted(f.getPath().getName() for f in found if f.isDirectory())
    from pyarrow import fs

    store, where = _store(spark, path)
    found = store.get_file_info(fs.FileSelector(where, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder with all it holds, if it is there."""
    if hasattr(spark, "_jsc"):
        store, where = _hadoop(spark, path)
        store.delete(where, True)
        return
    from pyarrow import fs

    store, where = _store(spark, path)
    if store.get_file_info(where).type == fs.FileType.Directory:
        store.delete_dir(where)
