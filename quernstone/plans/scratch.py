"""Tables written to the folder that all executors share: lineage ends there."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under the shared ``spark.checkpoint.dir``; removed when the driver ends.

    Only a session that names no checkpoint folder and runs in one process (tests) gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="quernstone-")
        path = f"{base.rstrip('/')}/quernstone-{sc.applicationId}"
        _folders[sc.applicationId] = path

        def remove() -> None:
            try:
                jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
                jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
            except Exception:  # noqa: BLE001  the session may be gone already
                pass

        atexit.register(remove)
    return _folders[sc.applicationId]


#: Rows of an Arrow batch while a scratch table is written. Whole texts travel in such batches, which both sides hold outside of
#: the heap; the default of 10,000 rows suits rows of numbers.
ARROW_ROWS = 1000
#: Rows of one file of ``portions`` at most.
PORTION_ROWS = 100_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession):
    """The session's Arrow batches have ARROW_ROWS rows at most inside, and their own size afterwards."""
    own = spark.conf.get(_ROWS)
    if 0 < int(own) <= ARROW_ROWS:
        yield
        return
    spark.conf.set(_ROWS, ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, own)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def portions(df: DataFrame, name: str, size: int = 0) -> list[DataFrame]:
    """df, written, as tables of about size bytes of files each (of one file, if that is more), which together hold its rows.

    For steps that may only run in a few tasks at once: they take one table after the other, and each reads its own files only.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with small_batches(spark):
        df.write.option("maxRecordsPerFile", PORTION_ROWS).parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = sorted((f.getPath().toString(), f.getLen()) for f in jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jpath) if f.getPath().getName().startswith("part-"))
    out, held, total = [], [], 0
    for k, (file, n) in enumerate(files):
        held.append(file)
        total += n
        if total >= size or k + 1 == len(files):
            part = spark.read.schema(df.schema).parquet(*held)
            part._scratch_path = held
            out.append(part)
            held, total = [], 0
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` or ``portions`` gave, of which nothing is read any more: what was made of them is written itself."""
    spark = None
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        for path in [] if path is None else [path] if isinstance(path, str) else path:
            spark = df.sparkSession
            sc = spark.sparkContext
            jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)
    if spark is not None:
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage: only then does Spark remove the shuffle files and broadcasts of plans that are done, and
    a driver of many compact plans would else wait long for that."""
    spark.sparkContext._jvm.System.gc()
