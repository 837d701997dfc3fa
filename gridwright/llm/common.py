"""Helpers shared by the training-data operators: scratch tables, batching, word scanning."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# ------------------------------------------------------------------ scratch tables
_WRITTEN: list[str] = []
_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in one process (tests, a laptop) may have none: a local folder is made for it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gridwright-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        _LOCAL.setdefault(spark.sparkContext.applicationId, found)
        found = _LOCAL[spark.sparkContext.applicationId]
    return found.rstrip("/")


_LOCAL: dict[str, str] = {}


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    A lost executor costs its running tasks only, not what earlier stages made.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridwright-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    _WRITTEN.append(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> None:
    """Hand freed native memory of the driver's JVM back to the system, where the JVM can do so.

    Its many short-lived threads each leave some behind; over a long pipeline that adds up to hundreds of MB.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    java = jvm.java.lang
    names = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    try:
        types, args = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
        for i, name in enumerate(names):
            types[i] = java.Class.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # another kind of JVM: nothing is lost but the saving
        pass


def materialize_bucketed(df: DataFrame, name: str, by: str, buckets: int, key: str) -> DataFrame:
    """As ``materialize``, dealt into buckets of ``key`` within folders of ``by``: joins on ``key`` need no shuffle of it."""
    spark = df.sparkSession
    table_name = f"gridwright_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table_name}"
    df.write.partitionBy(by).bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    _WRITTEN.append(path)
    _TABLES.append(table_name)
    return spark.table(table_name)


def written() -> int:
    """How many scratch tables there are now: a mark for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch tables written after the first ``since``, but for the last ``keep``; returns how many.

    Call when what was made of them is stored.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    last = len(_WRITTEN) - keep
    gone = _WRITTEN[since:last]
    _WRITTEN[since:last] = []
    for name in [t for t in _TABLES if any(path.endswith(f"/{t}") for path in gone)]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _TABLES.remove(name)
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _WRITTEN:
        try:
            release(spark)
        except Exception:  # the JVM may be gone by now; the shared folder is the cluster's to clean
            pass


# ------------------------------------------------------------------ bounded caches
class Cache(dict):
    """What ``make`` gives for a key, kept for about the ``size`` keys used last (two generations)."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.old = make, size // 2, {}

    def __missing__(self, key):
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_STATE: dict = {}


def worker_state(key, make):
    """What ``make`` gives, kept in this Python worker until another operator (another key) needs the room."""
    if key not in _STATE:
        if _STATE:
            _STATE.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # hand freed memory back: workers outlive operators
                trim(0)
        _STATE[key] = make()
    return _STATE[key]


# ------------------------------------------------------------------ tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Arrow batches stay small because texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The batch's texts as UTF-8; null counts as the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def slices(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever its case: for columns that come and go within an operator."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ------------------------------------------------------------------ words of byte strings
#: A word is a run of 0-9, a-z and bytes above 0x7F, after A-Z became a-z.
_U64 = np.uint64


@functools.cache
def _byte_tables(by_space: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is it part of a word, value in a word's hash) of each byte."""
    low = np.arange(256, dtype=np.uint8)
    word = np.zeros(256, bool)
    if by_space:
        word[:] = True
        word[list(b" \t\n\v\f\r")] = False
    else:
        low[65:91] += 32
        word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    value = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
    return word, np.where(word, value[low], _U64(0))


_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    a, b = _powers(size)
    return a[:n], b[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift, multiply) on unsigned 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


#: Bytes that are scanned at once: what is made on the way is many times as large.
SCAN = 1_000_000


def _after_word(word: np.ndarray, buf: np.ndarray, at: int) -> int:
    """The first place from ``at`` on that is no word's, or the end."""
    while at < len(buf):
        inside = word[buf[at : at + 4096]]
        if not inside.all():
            return at + int(inside.argmin())
        at += len(inside)
    return len(buf)


def scan_words(texts: list[bytes], by_space: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of all ``texts`` in one pass: (starts, ends, 64-bit hashes, word offset of each text, buffer).

    Starts and ends are byte offsets in the returned buffer, in which the texts
    stand one after another with a line break between.  With ``by_space`` a word is
    a run of other bytes than ASCII white space, as it stands.
    """
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    word, value = _byte_tables(by_space)
    found = []
    lo = 0
    while lo < len(buf):
        hi = _after_word(word, buf, min(len(buf), lo + SCAN))
        part = buf[lo:hi]
        edge = np.flatnonzero(np.diff(word[part].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            pw, inv = powers(len(part))
            found.append((starts + lo, ends + lo, mix64(np.add.reduceat(value[part] * pw, starts) * inv[starts])))
        lo = hi
    if found:
        starts, ends, h = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        starts, ends, h = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    lens = np.fromiter((len(x) for x in texts), np.int64, len(texts))
    text_start = np.concatenate([[0], np.cumsum(lens + 1)])
    return starts, ends, h, np.searchsorted(starts, text_start), raw


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
