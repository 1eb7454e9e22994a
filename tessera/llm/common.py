"""What the operators share: the shared scratch folder, packed blocks of numbers, and raw access to text columns."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
_MADE: list[str] = []
#: Fixed odd multipliers of the hashes.
ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _FALLBACK.append("file://" + made)
    return _FALLBACK[0]


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder so that lost executors cost no rerun."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _MADE.append(self.base)

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.base}/{label}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        _delete(self.spark, f"{self.base}/{label}")


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables that this driver made; results that were not written yet are lost."""
    while _MADE:
        _delete(spark, _MADE.pop())


#: Plan nodes under which the rows of a source keep their order and partitions.
_STEADY = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range"}


def stored(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` if every read of it numbers its rows alike (a plain read of stored data), else a stored copy."""

    def steady(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in _STEADY and all(steady(children.apply(i)) for i in range(children.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return df if plan.deterministic() and steady(plan) else scratch.save(df, "input")


def trim() -> None:
    """Gives memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if back:
        back(0)


def lean(f: Callable) -> Callable:
    """``f``, a function over batches (a generator) or over one or two groups, that gives unused memory back when done."""
    if inspect.isgeneratorfunction(f):

        def batches(some):
            yield from f(some)
            trim()

        return batches

    def group(rows):
        try:
            return f(rows)
        finally:
            trim()

    def groups(left, right):
        try:
            return f(left, right)
        finally:
            trim()

    return groups if len(inspect.signature(f).parameters) == 2 else group


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts of about ``size`` bytes in their column ``text``; a longer text is a part of its own."""
    for batch in batches:
        _, starts, stops = text_column(batch.column(text))
        ends = np.cumsum(stops - starts)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def parts(spark: SparkSession) -> int:
    """How many pieces to deal work into: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_parts(df: DataFrame, text_col: str, size: int) -> int:
    """How many pieces to deal texts into, so that one holds about ``size`` bytes of them; no fewer than :func:`parts`."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    return max(parts(df.sparkSession), -(-total // size))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; others, whatever they are called, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def expand(data: bytes) -> tuple[np.ndarray, ...]:
    """The arrays of a block."""
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def text_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column with each row's first and last position; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        e = np.zeros(len(col), np.int64)
        return np.zeros(0, np.uint8), e, e.copy()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1].copy(), at[1:].copy()
    if col.null_count:
        null = np.asarray(col.is_null())
        ends[null] = starts[null]
    return buf, starts, ends


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64-bit numbers that spreads close values apart."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def split_by_part(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal parts together, and the bounds of each part in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))


class RollingHash:
    """Hashes of slices from one running sum; good for texts up to the length given."""

    def __init__(self, length: int, odd: np.uint64, seed: int):
        self.codes, self.length = byte_codes(seed), length
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, odd)]))
        self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, np.uint64(pow(int(odd), -1, 1 << 64)))]))

    def sums(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([[np.uint64(0)], np.cumsum(self.codes[raw] * self.power[: len(raw)])])

    def slices(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * ODD2)


def with_row(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """doc, row (a number of its own for each stored row), text and carried columns (as strings)."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc"),
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        *[F.col(f"`{c}`").cast("string").alias(f"carry_{k}") for k, c in enumerate(carry)],
    )


def by_row(n: int):
    """The part, of ``n``, that a row's number falls in."""
    return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("dpart")


def row_frames(rows: DataFrame, n: int) -> DataFrame:
    """Rows of :func:`with_row`, compressed many together and dealt into ``n`` parts by row number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            buf, starts, ends = text_column(batch.column(3))
            missing = np.asarray(batch.column(3).is_null())
            order, bounds = split_by_part(batch.column(0).to_numpy(), n)
            plain = [batch.column(k).to_pylist() for k in (1, *range(4, batch.num_columns))]
            row = batch.column(2).to_numpy()
            press = zstandard.ZstdCompressor(level=3)
            part, data = [], []
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                o = order[bounds[p] : bounds[p + 1]]
                body = press.compress(b"".join(buf[starts[i] : ends[i]].tobytes() for i in o))
                part.append(p)
                data.append(pickle.dumps((row[o], ends[o] - starts[o], missing[o], body, [[c[i] for i in o] for c in plain]), 5))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(data, pa.binary())], names=["dpart", "data"])

    first = ["row", "text"]
    others = [c for c in rows.columns if c not in ("doc", *first)]
    return rows.select(by_row(n), "doc", *first, *others).mapInArrow(lean(run), "dpart int, data binary")


def frame_rows(frame: bytes) -> Iterator[tuple[int, bytes | None, list]]:
    """(row, text or None, doc and carried values) of a frame."""
    row, size, missing, body, plain = pickle.loads(frame)
    raw, stop = zstandard.ZstdDecompressor().decompress(body), 0
    for i in range(len(row)):
        begin, stop = stop, stop + int(size[i])
        yield int(row[i]), None if missing[i] else raw[begin:stop], [c[i] for c in plain]


def per_row(docs: DataFrame, asked: DataFrame, f: Callable[[Iterator[tuple[int, bytes | None, list]], pd.DataFrame], pd.DataFrame], schema: str, n: int) -> DataFrame:
    """``f`` over the frames of ``docs`` (from :func:`with_row`) and the rows of ``asked`` (has ``row``) of each part."""

    def run(frames: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return f((x for data in frames["data"] for x in frame_rows(data)), own)

    asked = asked.select(by_row(n), *asked.columns)
    return row_frames(docs, n).groupBy("dpart").cogroup(asked.groupBy("dpart")).applyInPandas(lean(run), schema)
