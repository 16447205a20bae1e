"""Cutting lineage through the folder that all executors share, and joins chosen by measured size."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent whole to every executor only up to this many bytes; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20


_shipped: set[str] = set()
_folders: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession) -> None:
    """Give the workers this package, whatever their folder and path; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="recollect-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where the session names none and runs in one process (as in tests) a temporary one is made; a cluster must name one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            known = current.get()
        else:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            known = "file://" + tempfile.mkdtemp(prefix="recollect-")
            spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table or file set, in this application's part of the shared folder, which is removed when the driver ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _folders:
        _folders[key] = f"{key[1]}/recollect-{key[0]}-{uuid.uuid4().hex[:8]}"
        fs, where = _file_system(spark, _folders[key])
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return f"{_folders[key]}/{uuid.uuid4().hex[:12]}-{name}"


def local_path(path: str) -> str:
    """The mounted path of a shared folder given as file: URL, for files that workers memory-map."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on the workers, not {path}")
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the result survives lost executors and has no lineage."""
    ship(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in staged:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            fs, where = _file_system(t.sparkSession, folder)
            fs.delete(where, True)


def fits(staged: DataFrame, row_bytes: int) -> bool:
    """Whether a staged table may be broadcast: its rows are counted, its width is given."""
    return staged.count() * row_bytes <= BROADCAST_BYTES


def join_sized(left: DataFrame, right: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with a staged right side: broadcast where its counted size allows, else a shuffle join that AQE may split."""
    return left.join(F.broadcast(right) if fits(right, row_bytes) else right, on, how)


def unused(name: str, *tables: DataFrame) -> str:
    """name, or name with as many underscores before it as make it a column of none of the tables, whatever the case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
