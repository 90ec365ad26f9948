"""What the operators share: table loading, code shipping, Arrow slices, byte and word hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a numpy loop works on; a longer single text is a step of its own.
SLICE_BYTES = 1 << 19


#: Rows of an Arrow batch at most: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 512


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once per Spark context, and batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if getattr(context, "_tarnflow_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tarnflow-code-")  # the driver serves it while the context lives
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tarnflow_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(path)
    context._tarnflow_shipped = True


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set, on one machine."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="tarnflow-checkpoints-")
        atexit.register(shutil.rmtree, found, True)
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows for which a task of a small table is worth its overhead.
TASK_ROWS = 25_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of ``df`` written to the shared checkpoint folder, without the lineage before.

    ``rows``, a bound on their number if it is known, keeps a small table in few partitions. The files
    go with ``drop``, or when the driver ends.
    """
    checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(8, -(-rows // TASK_ROWS)))
    out = df.checkpoint(eager=True)
    with contextlib.suppress(AttributeError, Py4JError):
        out._tarnflow_path = out._jdf.logicalPlan().rdd().getCheckpointFile().get()
        atexit.register(_remove, df.sparkSession, out._tarnflow_path)
    return out


def drop(*frames: DataFrame) -> None:
    """Removes the files of tables that ``cut`` or ``store`` wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tarnflow_path", None)
        if path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have gone, and the folder with it
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def store(df: DataFrame) -> DataFrame:
    """The same as a compressed table in the shared folder, for wide rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    atexit.register(_remove, df.sparkSession, path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tarnflow_path = path
    return out


def text_name(text: str) -> Column:
    """128 bits that tell texts apart, of two hashes that begin unlike; null counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(value), F.xxhash64(F.lit("other"), value))]
    return F.unhex(F.concat(*halves))


#: What a worker keeps from task to task, by operator.
KEPT: dict[str, dict] = {}


def settle(owner: str | None = None) -> dict:
    """At the start of a task: what other operators keep in this worker goes, and memory that is free goes
    back to the machine, as a worker is shared by all stages of an application. The owner's own stays."""
    others = [n for n in KEPT if n != owner]
    for name in others:
        del KEPT[name]
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
    return KEPT.setdefault(owner, {}) if owner else {}


class Texts:
    """Some rows of an Arrow batch: their texts as one byte array with row offsets."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        self.batch = batch
        values = batch.column(batch.schema.get_field_index(column))
        if values.null_count:
            values = values.fill_null("" if not pa.types.is_binary(values.type) else b"")
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        buffers = values.buffers()
        kind = np.int64 if wide else np.int32
        offsets = np.frombuffer(buffers[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.bytes = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
        self.offsets = offsets - offsets[0]
        self.n = len(values)

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name))

    def text(self, i: int) -> str:
        return bytes(self.bytes[self.offsets[i] : self.offsets[i + 1]]).decode("utf-8", "replace")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, keep: bool = False) -> Iterator[Texts]:
    """Runs of rows whose texts have about ``limit`` bytes together; a row is never divided.

    A task begins with this, so the worker settles, unless the caller has something to ``keep`` and has.
    """
    if not keep:
        settle()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        whole = Texts(batch, column)
        start = 0
        while start < n:
            end = int(np.searchsorted(whole.offsets, whole.offsets[start] + limit, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield Texts(batch.slice(start, end - start), column)
            start = end


def together(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of batches of ``limit`` bytes or a little more as one batch each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


# ---------------------------------------------------------------- hashing

#: An odd multiplier, 5 modulo 8, so that its powers repeat as late as they can.
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) >= n:
            return
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(cls, name, np.multiply.accumulate(steps))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base, modulo 2**64."""
    _Powers.need(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _Powers.up[: len(values)], out=out[1:])
    return out


def powers_down(n: int) -> np.ndarray:
    """The first n inverse powers of the base."""
    _Powers.need(n)
    return _Powers.down[:n]


#: Values for a second hash, of which two strings that agree in the first know nothing.
_OTHER_VALUES = mix(_BYTE_VALUES ^ np.uint64(0x2545F4914F6CDD1D))


def byte_prefix(data: np.ndarray, other: bool = False) -> np.ndarray:
    return prefix((_OTHER_VALUES if other else _BYTE_VALUES)[data])


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of [start, end), the same for equal content at any place; not yet mixed."""
    return (sums[end] - sums[start]) * _Powers.down[start]


# ---------------------------------------------------------------- words

#: Word bytes of the benchmark rule: digits, letters and all of UTF-8 above ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Word bytes of the white-space rule: all but space and 0x09 to 0x0D.
SOLID = np.ones(256, bool)
SOLID[0x09:0x0E] = SOLID[0x20] = False
#: A to Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of some texts: byte ranges, 64-bit hashes and word offsets of the rows."""

    def __init__(self, texts: Texts, kind: np.ndarray = ALNUM, lower: bool = True):
        data = LOWER[texts.bytes] if lower else texts.bytes
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind[data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        rows = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        if n:
            first[rows] = inside[1:-1][rows]
            ends = texts.offsets[1:][np.diff(texts.offsets) > 0] - 1
            last[ends] = inside[1:-1][ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.data = data
        self.hash = mix(ranges(byte_prefix(data), self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.offsets = np.searchsorted(self.start, texts.offsets)
        self.texts = texts

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), np.diff(self.offsets))

    def window_starts(self, size: int) -> np.ndarray:
        """Word numbers at which a window of ``size`` words of one row starts."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64)
        at = np.arange(n - size + 1)
        stop = self.offsets[1:][self.row[: n - size + 1]]
        return at[at + size <= stop]

    def windows(self, starts: np.ndarray, size: int) -> np.ndarray:
        if not hasattr(self, "_sums"):
            self._sums = prefix(self.hash)
        return mix(ranges(self._sums, starts, starts + size) + np.uint64(size))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
