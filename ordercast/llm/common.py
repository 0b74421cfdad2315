"""What the operators share: written tables, bounded batches, learning folds."""

from __future__ import annotations

import atexit
import ctypes
import functools
import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in runs of about so many characters, whatever Spark puts into a batch.
SLICE_CHARS = 2_000_000
#: A worker forgets what it has remembered about words beyond so many entries (results don't depend on it).
REMEMBERED = 250_000

#: Rows that a Python worker gets at a time, at most; a session's lower setting stays.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_folders: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, and get texts in moderate batches."""
    if int(spark.conf.get(_BATCH, "10000")) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{paths}".rstrip(":")


def _remove(folder: str) -> None:
    try:
        files, path = fs.FileSystem.from_uri(folder)
        files.delete_dir(path)
    except (OSError, ValueError):
        pass  # already gone, or the folder's store has no client here


def folder(spark: SparkSession) -> str:
    """This session's folder below ``spark.checkpoint.dir``; removed when Python ends.

    The setting is made here only for a session in one process that has none.
    """
    app = spark.conf.get("spark.app.id")
    if app not in _folders:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.conf.get("spark.master", "").startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "/tmp/checkpoints"
            spark.conf.set("spark.checkpoint.dir", shared)
        shared = shared.rstrip("/")
        shared = shared if "://" in shared or shared.startswith("file:") else f"file://{shared}"
        _folders[app] = f"{shared}/ordercast-llm-{uuid.uuid4().hex}"
        atexit.register(_remove, _folders[app])
    return _folders[app]


def release(spark: SparkSession) -> None:
    """Delete what this session's operators have written so far; results not yet read are gone."""
    if at := _folders.pop(spark.conf.get("spark.app.id"), None):
        _remove(at)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string")) % parts


def slices(lengths: Iterable[int], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Cut rows into runs of about ``limit`` characters; one longer row is a run of its own."""
    start = total = end = 0
    for end, n in enumerate(lengths, 1):
        total += n
        if total >= limit:
            yield slice(start, end)
            start, total = end, 0
    if start < end:
        yield slice(start, end)


def runs(texts: pd.Series, limit: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts of a batch in bounded runs; null is the empty text."""
    values = ["" if not isinstance(t, str) else t for t in texts.tolist()]
    for part in slices(map(len, values), limit):
        yield values[part]


_remembered: list[dict] = []


def remembered(found: dict) -> dict:
    """``found``, which a module keeps between calls; forgotten when a worker gives memory back."""
    _remembered.append(found)
    return found


def give_back() -> None:
    """Return what this process no longer uses to the system, where the C library can."""
    for found in _remembered:
        found.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function from batches to batches that gives memory back when its task ends.

    Spark keeps idle workers for later tasks, and each would go on holding what its largest task took.
    """

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def flat(parts: Iterable[Iterable]) -> Iterator:
    return itertools.chain.from_iterable(parts)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in itertools.count() if (n := f"_{stem}_{i}") not in taken)


#: Bits of the filter that :func:`perhaps_among` broadcasts: 4 MB, however many ids there are.
FILTER_BITS = 1 << 25


def perhaps_among(rows: DataFrame, key: str, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``key`` is among ``ids``, and few others: a bitmap of hashes, broadcast by its parts.

    It thins out rows before a join has to shuffle them; the join decides. With very many ids it lets
    more rows through, and the result stays the same. The test takes no Python worker: a task that also
    runs Python would keep two.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    part, bits = fresh(rows, "part"), fresh(rows, "bits")
    marked = ids.select(place(F.col(column)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(part))
    marked = marked.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    at = F.bitmap_bit_position(place(F.col(key))).cast("int")
    byte = F.conv(F.hex(F.substr(bits, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn(part, F.bitmap_bucket_number(place(F.col(key)))).join(F.broadcast(marked), part)
    return near.where(F.getbit(byte, F.pmod(at, F.lit(8))) == 1).drop(part, bits)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
