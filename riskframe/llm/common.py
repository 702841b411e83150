"""What several operators of this folder share: reading, staging and cutting texts into words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.session import fresh_path

#: White space of the word rule used in this folder: blank and the characters 9 to 13.
#: ``bytes.split()`` without argument cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

Batches = Iterator[pa.RecordBatch]

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only key and text, under fixed names; a null text counts as empty. Other columns of any name
    stay outside and so cannot clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``staged`` inside are deleted at the end. What is used afterwards must not be read from them:
    write it inside as ``lasting``."""
    made: list[str] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write an intermediate table to the shared folder, then let go of the shuffle files that
    led to it: nothing refers to them any more, and at scale they are as large as the input."""
    made, path = _SCRATCH.get(), fresh_path(df.sparkSession, "stage")
    if made is not None and not lasting:
        made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


_KEPT: dict[str, Callable[[], None]] = {}


def keep_only(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called inside tasks. Python workers live on between tasks, so an operator may keep a cache there;
    when a task of another operator starts, ``forget`` is called and the memory is given back."""
    others = [k for k in _KEPT if k != owner]
    for other in others:
        _KEPT.pop(other)()
    _KEPT[owner] = forget
    if others:
        gc.collect()
        release()


def release() -> None:
    """Give freed memory back to the system: idle workers keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def bound_batches(spark: SparkSession, size: int = SLICE_BYTES) -> None:
    """Let the session hand over batches of about ``size`` bytes, unless it has a bound of its own. Otherwise they have
    10,000 rows, and the executor and its Python worker both hold one as a whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(size))


def in_slices(batches: Batches, size: int = SLICE_BYTES) -> Batches:
    """Batches cut to about ``size`` bytes, so that what a task makes of them stays small; at their end freed
    memory is given back."""
    for batch in batches:
        rows = max(1, -(-batch.num_rows // max(1, round(batch.nbytes / size))))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    release()


def per_row(fn: Callable[..., tuple], inputs: list[str], outputs: pa.Schema) -> Callable[[Batches], Batches]:
    """A function on Arrow batches from one on rows: ``fn`` gets the values of ``inputs`` and returns
    one tuple in the order of ``outputs``."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = [fn(*values) for values in zip(*(batch.column(c).to_pylist() for c in inputs))]
            columns = list(zip(*rows)) if rows else [[] for _ in outputs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, outputs)], schema=outputs)
    return run


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
