"""Shared helpers: the scratch folder, table access, and vectorised work on UTF-8 buffers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def tuned(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session has Spark's defaults."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
    if int(spark.conf.get(size, str(2**31 - 1)).rstrip("bB")) > 1 << 28:
        spark.conf.set(size, str(BATCH_BYTES))


def released(run):
    """run, a function of Arrow batches, that gives what it has freed back to the system at its end: workers are
    kept for later stages, and what one stage held would stand beside what the next one needs."""

    def again(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return again


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read through Spark so that any store works."""
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where it is unset and all tasks run here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gatewarden-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def saved(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    tuned(df.sparkSession)
    path = f"{scratch(df.sparkSession)}/gatewarden/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plus(df: DataFrame, **types: str) -> T.StructType:
    """df's schema with more columns."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in types.items():
        out = out.add(name, T.StructType.fromDDL(f"x {kind}")[0].dataType)
    return out


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    _, off, data = arr.buffers()
    offs = np.frombuffer(off, np.int64, count=n + 1 + arr.offset)[arr.offset :]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8, count=offs[-1])[offs[0] :]
    return raw, offs - offs[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_CODE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D | 1
_powers: list[np.ndarray] = []


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        if n > 1 << 20:  # for one long text: not kept
            return _power_pair(n)
        _powers.clear()
        _powers.extend(_power_pair(size))
    return _powers[0][:n], _powers[1][:n]


def prefix_code(data: np.ndarray) -> np.ndarray:
    """Running polynomial code c, with code of [s, e) = (c[e] - c[s]) * base**-s."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_CODE[data] * up, out=out[1:])
    return out


def span_codes(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each byte string [start, end); equal strings have equal codes."""
    _, down = powers(len(code))
    return mix((code[ends] - code[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total): maximal runs of bytes with inside[b], never across rows."""
    flag = inside[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = flag
    before[offsets] = False
    starts = np.flatnonzero(flag & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = flag
    after[offsets] = False
    ends = np.flatnonzero(flag & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def blocks(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes each (a single longer row stands alone)."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        end = min(end, n)
        out.append((at, end))
        at = end
    return out
