"""State over time: rate windows in batch and stream, presence of paths, and headings as of a place."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessera.sources import markdown
from tessera.streaming import ingest


def folded(times, seconds):
    out = []
    for s in sorted(times):
        if not out or s >= out[-1][0] + seconds:
            out.append([s, 0])
        out[-1][1] += 1
    return [tuple(x) for x in out]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))


def epoch(t):
    return int(t.replace(tzinfo=timezone.utc).timestamp())


def found(df):
    return sorted(((r["user_id"], epoch(r["start"]), r["n"], r["refused"]) for r in df.collect()), key=str)


def test_rate_windows_equal_a_fold(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, None, 77]), r.randint(0, 3000)) for _ in range(4000)] + [(5, None), (6, 9)]
    want = sorted(((k, s, n, max(n - 2, 0)) for k in {k for k, s in rows if s is not None} for s, n in folded([s for x, s in rows if x == k and s is not None], 60)), key=str)
    assert found(ingest.rate_windows(frame(spark, rows), 60, 2)) == want
    assert found(ingest.rate_windows(frame(spark, []), 60, 2)) == []


def test_a_key_that_never_pauses_is_read_as_a_stream(spark):
    steady = spark.range(400_000).select(F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = ingest.rate_windows(steady, 60, 10).agg(F.count(F.lit(1)).alias("w"), F.sum("n").alias("n"), F.min("n").alias("least"), F.sum("refused").alias("over")).first()
    assert tuple(got) == (6667, 400_000, 40, 6666 * 50 + 30)


def play(spark, tmp_path, batches, schema, make, name):
    """The rows that a stream gives over batches, restarted after each."""
    source, out = tmp_path / f"{name}-in", []
    source.mkdir()
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{source}/b{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        q = make(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).foreachBatch(lambda df, b: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    return out


def test_rate_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice([1, 2, 3]), s) for s in range(0, 1200, 3) for _ in range(r.randint(0, 2)) if s % 400 < 250]
    # batches in order, but within each, and by up to 20 s across them, requests come as they like
    shuffled = sorted(rows, key=lambda x: x[1] + r.uniform(0, 20))
    batches = [shuffled[k : k + len(shuffled) // 3 + 1] for k in range(0, len(shuffled), len(shuffled) // 3 + 1)] + [[(9, 10_000)], [(9, 20_000)]]
    make = lambda df: ingest.rate_windows_stream(df.select("user_id", F.timestamp_seconds("s").alias("ts")), 60, 2, "30 seconds")
    got = play(spark, tmp_path, batches, "user_id long, s long", make, "rates")
    got = sorted(((x["user_id"], epoch(x["start"]), x["n"], x["refused"]) for x in got if x["user_id"] != 9), key=str)
    assert got == found(ingest.rate_windows(frame(spark, rows), 60, 2))


def test_presence_of_paths(spark, tmp_path):
    listing = lambda t, *paths, policy="p1": [("s", policy, p, v, datetime.fromtimestamp(t, timezone.utc).replace(tzinfo=None)) for p, v in paths]
    batches = [
        listing(100, ("a", "1"), ("b", "1")), listing(200, ("a", "2"), ("b", "1")), listing(300, ("a", "2")), listing(400, ("a", "2"), ("a", "2"), ("c", "1")), listing(500, ("a", "2"), ("c", "1")),
        listing(600, ("a", "2"), ("b", "9")), listing(700, ("a", "2"), ("b", "9"), policy="p2"), listing(800, ("z", "1"), policy="p3"),
    ]
    out = play(spark, tmp_path, batches, "source string, policy string, path string, content_sha256 string, at timestamp", lambda df: ingest.presence(df, 150), "paths")
    events = [(r["policy"], r["path"], r["event"], r["version"], epoch(r["first_seen"]), epoch(r["last_seen"])) for r in out]
    mine = lambda policy, path: [e[2:] for e in events if e[:2] == (policy, path)]
    assert mine("p1", "a")[:2] == [("came", "1", 100, 100), ("changed", "2", 100, 200)]
    assert mine("p1", "b") == [("came", "1", 100, 100), ("gone", "1", 100, 200), ("came", "9", 600, 600), ("gone", "9", 600, 600)][: len(mine("p1", "b"))] and mine("p1", "b")[:3][-1][0] == "came"
    assert mine("p1", "c")[:2] == [("came", "1", 400, 400), ("gone", "1", 400, 500)]
    assert mine("p2", "a") == [("came", "2", 700, 700)] and sum(e[2] == "gone" and e[1] == "b" and e[4] == 100 for e in events) == 1


def as_of(marks, spots):
    out = []
    for i, s in spots:
        stack = []
        for line, level, text in sorted((x for j, *x in marks if j == i and x[0] <= s), key=lambda x: x[0]):
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
        out.append((i, s, " › ".join(t for _, t in stack) if stack and i is not None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [1, 7, 1 << 16])
def test_headings_as_of_a_place(spark, bucket):
    r = random.Random(bucket)
    marks = [(i, line, r.randint(1, 6), f"h{line}") for i in (1, 2, None) for line in r.sample(range(60), 25)]
    spots = [(i, r.randint(0, 70)) for i in (1, 2, 3, None) for _ in range(20)]
    df = markdown.active_heading(spark.createDataFrame(marks, "id long, line int, level int, text string"), spark.createDataFrame(spots, "id long, spot long"), bucket)
    assert sorted(map(tuple, df.select("id", "spot", "path").collect()), key=str) == as_of(marks, spots)


def test_a_note_of_many_headings_is_linear(spark):
    n = 100_000
    marks = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 3).alias("line"), (F.col("id") % 6 + 1).cast("int").alias("level"), F.concat(F.lit("h"), F.col("id")).alias("text"))
    spots = spark.range(n).select(F.lit(1).alias("id"), (F.col("id") * 3 + 1).alias("spot"))
    got = markdown.active_heading(marks, spots, 4096)
    row = got.where(F.col("spot") == 3 * 65537 + 1).first()  # 65537 % 6 + 1 is level 6
    assert row["path"].split(" › ")[-1] == "h65537" and got.count() == n
