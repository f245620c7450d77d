"""Helpers that several operators use: shared tables, sizes, hashing of words and windows."""

from __future__ import annotations

import atexit
import ctypes
import math
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one numpy pass holds at a time; its temporaries take about 40 times as much.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a folder of this machine does if all tasks run on it; on a cluster it would not, and this raises.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.spanloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.spanloom.shared.dir", found)
    return found


#: While a table is written or pieces are collected: shuffle files go when that is done and not when the driver's garbage happens to be collected;
#: batches for Python end at so many bytes, however long the rows are.
_CONFIGURED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}
#: Paths of the tables of each scratch() that is open here; a thread has its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())
#: By session, how many are in sparing() and what the settings were before the first of them.
_sparing: dict[int, tuple[int, dict]] = {}
_lock = threading.Lock()


@contextmanager
def sparing(spark: SparkSession):
    """What runs inside spares disk and memory; the session's settings are restored when the last one inside is done, in whatever thread."""
    with _lock:
        users, before = _sparing.get(id(spark), (0, {}))
        if not users:
            before = {k: spark.conf.get(k, None) for k in _CONFIGURED}
            for k, v in _CONFIGURED.items():
                spark.conf.set(k, v)
        _sparing[id(spark)] = users + 1, before
    try:
        yield
    finally:
        with _lock:
            users, before = _sparing.pop(id(spark))
            if users > 1:
                _sparing[id(spark)] = users - 1, before
            else:
                for k, v in before.items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def scratch(spark: SparkSession):
    """The tables that materialize() writes inside, in this thread, go at the end, but for lasting ones. Nothing lazy may be left that reads the others."""
    mine: list[str] = []
    before = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(before)
        for path in mine:
            _remove(spark, path)


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and return the table: the lineage is cut and survives lost executors.

    lasting: the table outlives the innermost scratch() and is one of the next outer one's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with sparing(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    held = _open.get()
    if len(held) > lasting:
        held[-1 - lasting].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete what materialize() wrote, before the process ends; nothing may read it any more."""
    _remove(table.sparkSession, table._stored_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def stored_bytes(df: DataFrame) -> int:
    """The size of the files that df scans, in proportion to the data; where df is more than a scan, the bytes of its texts."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and size < 1 << 60:  # without files, the estimate is the largest number there is
        return size
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def parts_for(size: int, target: int, least: int) -> int:
    """So many partitions that each gets about target bytes."""
    return max(least, math.ceil(size / target))


# --- memory of workers ---------------------------------------------------------------------------------------------

#: glibc's malloc_trim, or None elsewhere.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return free memory to the system; a process would keep most of it for later."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run):
    """run, a function for mapInArrow, in workers that give their memory back after each batch: idle workers stay, beside those that work."""

    def spared(batches):
        def each():
            for batch in batches:
                yield batch
                give_back()

        try:
            yield from run(each())
        finally:
            give_back()

    return spared


# --- words ---------------------------------------------------------------------------------------------------------

_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.array([_SEPARATOR[c] or c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Pseudorandom values of a byte at a place in its word, for two independent hashes; further places are computed.
_NEAR = 64
_VALUES = [mix(np.arange(_NEAR << 8, dtype=np.uint64), 20 + lane) for lane in (0, 1)]


def word_hashes(chars: np.ndarray, lengths: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of words that stand in chars one after the other: sums of values drawn for each byte and its place."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(chars), dtype=np.int32) - np.repeat(first.astype(np.int32), lengths)
    key = (np.minimum(place, _NEAR - 1) << 8) | chars
    values = _VALUES[lane][key]
    far = np.flatnonzero(place >= _NEAR - 1) if int(lengths.max()) >= _NEAR else place[:0]
    values[far] = mix((place[far].astype(np.uint64) << np.uint64(8)) | chars[far], 30 + lane)
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _STEP, 1 + lane)


@dataclass
class Words:
    """The words of some documents: document index, byte span in data, 64-bit hash, all by word; first word by document.

    chars: the words' bytes one after the other.
    """

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    chars: np.ndarray

    def second(self) -> np.ndarray:
        """A further hash of each word; the two together have 128 bits."""
        return word_hashes(self.chars, self.end - self.start, 1)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every window of n consecutive words of one document."""
        h = window_hashes(self.hash, n)
        at = np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(h)]) if len(h) else np.zeros(0, np.int64)
        return at, h[at]


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of left sequences followed by right ones. No sum of powers: equal sums in another order don't agree."""
    x = left * _STEP + right
    x ^= x >> np.uint64(32)
    x *= _TURN
    x ^= x >> np.uint64(29)
    return x


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive hashes of words, from those of halves, quarters and so on."""
    if len(words) < n or n < 1:
        return np.zeros(0, np.uint64)
    count, power, width, out, done = len(words) - n + 1, words, 1, None, 0
    while True:
        if n & width:
            piece = power[done : done + count]
            out, done = piece if out is None else join_hashes(out, piece), done + width
        if done == n:
            return mix(out, n)
        power = join_hashes(power[:-width], power[width:])
        width *= 2


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts in one array and the offsets of each; null counts as empty."""
    a = texts.cast(pa.large_string())
    if a.null_count:
        a = a.fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False) -> Words:
    """The words [^\\x20\\x09-\\x0D]+ of each text; lower: with A-Z in lower case; plain: ASCII punctuation parts words too."""
    n = len(data)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not((_PLAIN if plain else _SEPARATOR)[data], out=inside[1:-1])
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    chars = data[inside[1:-1]]
    h = word_hashes(chars, e - s)
    first = np.searchsorted(s, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, doc, s, e, h, first, chars)


def slices(batch: pa.RecordBatch, column: str = "text"):
    """batch in runs of rows with about SLICE_BYTES of text; one longer text is a run of its own."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at)
        at = to


# --- packing -------------------------------------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    """The array's bytes in planes (all lowest bytes first), which compresses small numbers well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    """The inverse of pack()."""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).ravel() if b else np.zeros(0, dtype)


# --- filters -------------------------------------------------------------------------------------------------------

#: A filter of keys has at most so many bytes; with more keys it lets more others through, and nothing is lost.
FILTER_BYTES = 1 << 23
_PIECE = 1 << 16


def pieces_of(a: np.ndarray) -> pa.RecordBatch:
    """An array of 32-bit numbers as rows (piece, body)."""
    parts = np.array_split(a, max(1, len(a) * 4 // _PIECE))
    return pa.RecordBatch.from_pydict({"piece": pa.array(range(len(parts)), pa.int32()), "body": pa.array([p.tobytes() for p in parts], pa.binary())})


def merge_pieces(pieces: DataFrame, length: int, how) -> np.ndarray:
    """The arrays of length 32-bit numbers of all tasks, rows of pieces_of(), merged by how; zeros where there are none."""

    def run(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, body in zip(batch.column("piece").to_pylist(), batch.column("body").to_pylist(), strict=True):
                new = np.frombuffer(body, np.int32)
                merged[p] = how(merged[p], new) if p in merged else new
        if merged:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(merged), pa.int32()), "body": pa.array([v.tobytes() for v in merged.values()], pa.binary())})

    with sparing(pieces.sparkSession):
        rows = pieces.repartition(max(1, min(length * 4 // _PIECE, 16)), "piece").mapInArrow(lean(run), "piece int, body binary").collect()
    return np.concatenate([np.frombuffer(r["body"], np.int32) for r in sorted(rows, key=lambda r: r["piece"])]) if rows else np.zeros(length, np.int32)


def _probe(h: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(h, 40 + k) & np.uint64(bits - 1)
    return (x >> np.uint64(5)).astype(np.int64), np.uint32(1) << (x & np.uint64(31)).astype(np.uint32)


def key_filter(keys: DataFrame, per_key: int = 64, probes: int = 3, most_bytes: int = FILTER_BYTES) -> list[np.ndarray]:
    """A Bloom filter of the only column of keys (bigint), for holds(): per_key bits a key, most_bytes at most."""
    bits = 1 << min((most_bytes * 8).bit_length() - 1, max(10, math.ceil(math.log2(per_key * max(1, keys.count())))))

    def mark(batches):
        marks = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            h = np.array(batch.column(0), np.int64).view(np.uint64)
            for k in range(probes):
                where, bit = _probe(h, k, bits)
                np.bitwise_or.at(marks, where, bit)
        yield pieces_of(marks.view(np.int32))

    merged = merge_pieces(keys.mapInArrow(lean(mark), "piece int, body binary"), bits // 32, np.bitwise_or)
    return [np.frombuffer(merged.tobytes(), np.uint32), np.array(probes)]


def holds(marks: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Positions in h of the keys that the filter lets through."""
    at = np.arange(len(h))
    for k in range(int(marks[1])):
        where, bit = _probe(h[at], k, len(marks[0]) * 32)
        at = at[marks[0][where] & bit > 0]
    return at
