"""Helpers shared by the corpus operators: words, folds and tables in the shared folder."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word pattern [^\x20\x09-\x0D]+; bytes.split() cuts at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of texts that go to a Python worker at once; Spark holds about four times as many a task on its side.
BATCH_BYTES = 4 << 20


def vectorized(kind: str, once: bool = False) -> Callable:
    """A pandas UDF of the SQL type `kind`, made when it is first called, since types are parsed by a session.

    once: the optimizer must not run it a second time, as for a filter on its result."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*cols: Column | str) -> Column:
            udf = F.pandas_udf(f, kind)
            return (udf.asNondeterministic() if once else udf)(*cols)

        return call

    return wrap


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers at most BATCH_BYTES at once, unless it has a setting of its own; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if re.fullmatch(r"\d+b", spark.conf.get(key)):  # the default as Spark writes it
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Memory that this Python worker has freed goes back to the system, which else keeps it for the worker while it is idle."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def tidy(task: Callable) -> Callable:
    """A generator of a Python task that ends with give_back()."""

    @functools.wraps(task)
    def run(batches):  # noqa: ANN001, ANN202  annotated as the task is
        yield from task(batches)
        give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text as UTF-8; none for a null text."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fold(key: str | Column, n: int) -> Column:
    """crc32(key as text) mod n; a null key falls in fold 0."""
    c = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one, but only if all is one machine."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts lineage and survives a lost executor.

    Results are lazy and read these tables, so they stay as long as the folder, which belongs to one application."""
    path = f"{shared_dir(df.sparkSession)}/corpus-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the table of stored() that df reads, as soon as all that was made of it is stored itself."""
    at = {m[0] for f in df.inputFiles() if (m := re.match(r".*/corpus-[0-9a-f]{32}(?=/)", f))}
    sc = df.sparkSession.sparkContext
    for path in at:
        path = sc._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def together(texts: Iterable[bytes], size: int) -> Iterator[list[bytes]]:
    """Neighbouring texts in lists of about `size` bytes."""
    part: list[bytes] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part
