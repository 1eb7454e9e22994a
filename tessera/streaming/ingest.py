"""Continuous ingestion, event windows, and per-key counters on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, root: str, build: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds", glob: str = "*.md") -> StreamingQuery:
    """Offer new files of a folder to ``build`` in micro-batches; the checkpoint makes restarts resume."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return newest_only(files.writeStream, build, f"{checkpoint}/built").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def newest_only(writer, build: Callable[[DataFrame, int], None], marks: str):
    """Run ``build`` for batches in order; a batch that comes again after a restart is skipped.

    A file in the folder ``marks``, which any store can hold, tells that a batch was built. If the driver is lost
    between a build and its mark, the batch is built again, so ``build`` must replace what it wrote for it.
    """

    def run(df: DataFrame, batch: int) -> None:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(marks).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
        mark = path(f"{marks}/{batch:012d}")
        if fs.exists(mark):
            return
        build(df, batch)
        fs.create(mark, True).close()
        fs.delete(path(f"{marks}/{batch - 2:012d}"), False)

    return writer.foreachBatch(run)


def tumbling(events: DataFrame, size: str, late: str | None = None, ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(start, key, n, total) per window; with ``late``, a stream drops what comes later than that."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None, ts: str = "ts", key: str = "event_type") -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, size, step).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, gap: str, late: str | None = None, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, end, n) of runs of events less than ``gap`` apart."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_seen(events: DataFrame, late: str, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, first_seen, last_seen) of a stream, kept per key; emitted with each batch that changes it."""
    return events.withWatermark(ts, late).groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


_RATES = "start long, n long"


def _windows(steps: Iterator[tuple[int, int]], start: int | None, n: int, seconds: int) -> Iterator[tuple[int | None, int, bool]]:
    """Folds (second, count) steps in order into windows: those that end, marked so, and last of all the open one."""
    for s, count in steps:
        if start is None or s >= start + seconds:
            if start is not None:
                yield start, n, True
            start, n = s, 0
        n += count
    yield start, n, False


def rate_windows(requests: DataFrame, seconds: int = 60, most: int = 60, ts: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, start, n, refused): counts per window that starts at a key's first request after the last window.

    Windows depend on one another, so times are folded in order, in whole seconds with counts. A partition holds whole
    keys in order, and is read as a stream: what is held is one window, however long a key goes on. Requests without a
    time do not count.
    """
    second = requests.groupBy(F.col(key).alias("k"), F.unix_seconds(F.col(ts).cast("timestamp")).alias("s")).agg(F.count(F.lit(1)).alias("n")).where("s is not null")
    # a null key is one key
    ordered = second.select("k", F.coalesce(F.col("k").cast("string"), F.lit("")).alias("name"), F.col("k").isNull().alias("none"), "s", "n")
    ordered = ordered.repartition("name", "none").sortWithinPartitions("none", "name", "s")
    kind = dict(second.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n, value = None, None, 0, None
        for batch in batches:
            own, names, none, s, counts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            at, out = 0, ([], [], [])
            while at < len(s):
                who = (none[at], names[at])
                stop = at
                while stop < len(s) and (none[stop], names[stop]) == who:
                    stop += 1
                if who != last and start is not None:
                    [c.append(x) for c, x in zip(out, (value, start, n))]
                if who != last:
                    last, start, n, value = who, None, 0, own[at].as_py()
                for begun, count, ended in _windows(zip(s[at:stop], counts[at:stop]), start, n, seconds):
                    if ended:
                        [c.append(x) for c, x in zip(out, (value, begun, count))]
                    start, n = begun, count
                at = stop
            yield pa.RecordBatch.from_arrays([pa.array(out[0], own.type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["k", "start", "n"])
            kept = own.type
        if start is not None:
            yield pa.RecordBatch.from_arrays([pa.array([value], kept), pa.array([start], pa.int64()), pa.array([n], pa.int64())], names=["k", "start", "n"])

    return _rated(ordered.mapInArrow(run, f"k {kind}, {_RATES}"), key, most)


def _rated(windows: DataFrame, key: str, most: int) -> DataFrame:
    return windows.select(F.col("k").alias(key), F.timestamp_seconds("start").alias("start"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("refused"))


def rate_windows_stream(requests: DataFrame, seconds: int = 60, most: int = 60, late: str = "1 minute", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """The rows of :func:`rate_windows` from a stream, each once its window has ended for good.

    A key's state is its open window and the counts of the seconds that late requests may still add to, which are
    folded in order when the watermark has passed them. A timer at the end of the window gives it out, also if the key
    never comes again, and a key with nothing open leaves no state.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n, held, counts = state.get if state.exists else (None, 0, [], [])
        start = None if start is None or pd.isna(start) else int(start)
        waiting = {int(s): int(c) for s, c in zip(held, counts)}
        for pdf in batches:
            for s, c in pdf["s"].value_counts().items():
                waiting[int(s)] = waiting.get(int(s), 0) + int(c)
        mark = state.getCurrentWatermarkMs()
        ready = sorted(s for s in waiting if (s + 1) * 1000 <= mark)
        out = []
        for begun, count, ended in _windows(((s, waiting.pop(s)) for s in ready), start, n, seconds):
            if ended:
                out.append((begun, count))
            start, n = begun, count
        if start is not None and (start + seconds) * 1000 <= mark:
            out.append((start, n))
            start, n = None, 0
        if start is None and not waiting:
            state.remove()
        else:
            held = sorted(waiting)
            state.update((start, n, held, [waiting[s] for s in held]))
            due = 1000 * min([s + 1 for s in held[:1]] + ([] if start is None else [start + seconds]))
            state.setTimeoutTimestamp(max(due, mark + 1))
        yield pd.DataFrame({"k": [k[0]] * len(out), "start": [x[0] for x in out], "n": [x[1] for x in out]})

    # a batch sends a second's requests of a key one by one: they are counted where the state is
    rows = requests.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late).select("_t", F.col(key).alias("k"), F.unix_seconds("_t").alias("s"))
    kind = dict(rows.dtypes)["k"]
    folded = rows.where("_t is not null").groupBy("k").applyInPandasWithState(update, f"k {kind}, {_RATES}", "start long, n long, held array<long>, counts array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return _rated(folded, key, most)


def presence(listings: DataFrame, grace: int, late: str = "0 seconds", at: str = "at", keys: Sequence[str] = ("source", "policy"), path: str = "path", version: str = "content_sha256") -> DataFrame:
    """What becomes of paths in a stream of listings: (keys, path, event, version, first_seen, last_seen).

    Each listing names all paths that are there, with the time ``at`` of the listing. A path comes (``came``), has new
    contents (``changed``), or is named no more for ``grace`` seconds (``gone``, once; if it comes again it is new).
    State is kept by source, policy and path across batches and restarts, so another policy sees all paths anew; a
    path that is gone leaves none.
    """
    names = [*keys, path]

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = state.get if state.exists else None
        out = []
        told = sorted({(int(m), v) for pdf in batches for m, v in zip(pdf["ms"], pdf["v"])}, key=lambda x: (x[0], x[1] or ""))
        for ms, v in told:
            if known and ms - known[1] > grace * 1000:
                out.append(("gone", known[2], known[0], known[1]))
                known = None
            event = "came" if known is None else "changed" if v != known[2] and ms >= known[1] else None
            first, last = (known[0], max(known[1], ms)) if known else (ms, ms)
            known = (first, last, v if known is None or ms >= known[1] else known[2])
            if event:
                out.append((event, v, first, last))
        mark = state.getCurrentWatermarkMs()
        if known and known[1] + grace * 1000 < mark:
            out.append(("gone", known[2], known[0], known[1]))
            known = None
        if known is None:
            state.remove()
        else:
            state.update(known)
            state.setTimeoutTimestamp(max(known[1] + grace * 1000 + 1, mark + 1))
        yield pd.DataFrame([(*k, *x) for x in out], columns=[*names, "event", "version", "first_ms", "last_ms"])

    rows = listings.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    rows = rows.where("_t is not null").select("_t", *names, F.unix_millis("_t").alias("ms"), F.col(version).alias("v"))
    schema = ", ".join(f"`{c}` string" for c in names) + ", event string, version string, first_ms long, last_ms long"
    rows = rows.select("_t", *[F.col(c).cast("string").alias(c) for c in names], "ms", "v")
    events = rows.groupBy(*names).applyInPandasWithState(update, schema, "first_ms long, last_ms long, v string", "append", GroupStateTimeout.EventTimeTimeout)
    stamp = lambda c: F.timestamp_millis(c)
    return events.select(*names, "event", "version", stamp("first_ms").alias("first_seen"), stamp("last_ms").alias("last_seen"))


def running_totals(events: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """(key, n, total) of a stream by a stateful function; the state is two numbers per key."""

    def update(k, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")
