"""What a session needs: this package on its executors, and a folder that they share with the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()
_open: list[list[DataFrame]] = []
#: The setting by which Spark removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, for sessions started without it on PYTHONPATH."""
    context = spark.sparkContext
    if context in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(_own_folder(), "siltstone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    _shipped.add(context)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and everything runs in one process on this machine, one of our own; on a cluster that is an error, as
    every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {master})")
        folder = "file://" + _own_folder()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def leftovers() -> Iterator[list[DataFrame]]:
    """A list of the tables kept within that nobody has discarded, for who knows when their readers are done."""
    made: list[DataFrame] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)


def kept(df: DataFrame, name: str, done: tuple[DataFrame, ...] = (), codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and reread it; then the shuffle files behind it go.

    This cuts the lineage: a lost executor costs later steps a reread, not the work before. done:
    kept tables that nothing else reads, which are deleted after the write; others stay until the
    folder is emptied, as with checkpoint().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone/{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    discard(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    for made in _open:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more."""
    for t in tables:
        for made in _open:
            made[:] = [m for m in made if m is not t]
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.kept_at).getParent()
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
