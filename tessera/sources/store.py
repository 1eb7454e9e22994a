"""Generations on storage: immutable table folders, and numbered pointers, one more when a generation is complete.

Tables are written by Spark to any store. Pointers and manifests are small files with checksums, made through the same
file system and never changed: the pointer with the greatest number is the current one. Two writers ask for the same
next number, which only one of them gets, and a reader always finds a whole pointer, the old or the new one.

A table may be kept in segments: a generation then holds only its own rows and the keys whose earlier rows they replace,
and names the generations of the earlier segments. Reading merges them; pruning keeps them as long as they are named.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.ids import digest
from tessera.operators import segments


class Conflict(RuntimeError):
    """The pointer was moved by someone else."""


def table_digest(df: DataFrame) -> dict[str, int]:
    """Row count and an order-free fold of row hashes."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) if t.startswith("map") or "map<" in t else F.col(c) for c, t in df.dtypes])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return {"rows": r["n"], "xor": r["x"], "sum": r["s"]}


@dataclass(frozen=True)
class Segmented:
    """How a table is kept in segments: its key, and the table that names the replaced keys (in column ``key``)."""

    key: str
    gone: str


class Store:
    """Publishing, reading, rolling back and pruning of generations under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _write(self, name: str, value: dict) -> bool:
        """Make a file that must not be there yet; false if it is."""
        try:
            stream = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as e:
            if self._fs.exists(self._path(f"{self.root}/{name}")):
                return False
            raise OSError(f"could not make {name}") from e
        stream.write(bytearray(json.dumps(value | {"checksum": digest(value)}, sort_keys=True).encode()))
        stream.close()
        return True

    def _whole(self, name: str) -> dict | None:
        """The contents of a file if its checksum holds."""
        try:
            found = self._read(name)
        except ValueError:  # a writer stopped within it
            return None
        body = {k: v for k, v in (found or {}).items() if k != "checksum"}
        return body if found and found.get("checksum") == digest(body) else None

    def _pointers(self) -> list[int]:
        folder = self._path(f"{self.root}/pointers")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _now(self) -> tuple[int, str | None]:
        """The greatest pointer's number, and the generation of the greatest whole one."""
        numbers = self._pointers()
        whole = (p for n in reversed(numbers) if (p := self._whole(f"pointers/{n:012d}.json")))
        return (numbers[-1] if numbers else 0), next((p["generation"] for p in whole), None)

    def _move(self, after: int, generation: str) -> None:
        if not self._write(f"pointers/{after + 1:012d}.json", {"generation": generation}):
            raise Conflict("the pointer moved meanwhile")

    def current(self) -> str | None:
        return self._now()[1]

    def manifest(self, generation: str) -> dict:
        found = self._whole(f"{generation}/manifest.json")
        if not found:
            raise ValueError(f"generation {generation} has no valid manifest")
        return found

    def publish(
        self,
        tables: dict[str, DataFrame],
        expected: str | None = None,
        note: dict | None = None,
        deltas: Mapping[str, Segmented] | None = None,
    ) -> str:
        """Write tables, then their manifest, then move the pointer if it is still at ``expected``.

        The tables in ``deltas`` are added to their segments in the expected generation; all others are whole.
        """
        number, now = self._now()
        if now != expected:
            raise Conflict(f"expected {expected}, found {now}")
        kept = self._segments(expected) if deltas else {}
        generation = f"gen-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        sums = {}
        for name, df in tables.items():
            path = f"{self.root}/{generation}/{name}"
            df.write.parquet(path)
            sums[name] = table_digest(self.spark.read.schema(df.schema).parquet(path))
        told = {n: {"key": d.key, "gone": d.gone, "parts": [*kept.get(n, {"parts": [expected]})["parts"], generation]} for n, d in (deltas or {}).items()}
        body = {"generation": generation, "parent": expected, "tables": sums, "schemas": {n: d.schema.json() for n, d in tables.items()}, "segments": told, "note": note or {}}
        self._write(f"{generation}/manifest.json", body)
        self._move(number, generation)
        return generation

    def _segments(self, generation: str) -> dict[str, dict]:
        return self.manifest(generation).get("segments", {})

    def part(self, name: str, generation: str) -> DataFrame:
        """The rows of a table that were written with a generation, without those of earlier segments."""
        schema = StructType.fromJson(json.loads(self.manifest(generation)["schemas"][name]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{generation}/{name}")

    def read(self, name: str, generation: str | None = None) -> DataFrame:
        g = generation or self.current()
        if g is None:
            raise ValueError("nothing is published")
        held = self._segments(g).get(name)
        if held is None:
            return self.part(name, g)
        parts = [(self.part(name, p), self.part(held["gone"], p) if k else None) for k, p in enumerate(held["parts"])]
        return segments.merged(parts, held["key"], "key")

    def verify(self, generation: str | None = None) -> list[str]:
        """Names of tables that differ from their manifest, in the generation or in one that it has segments in."""
        g = generation or self.current()
        parts = dict.fromkeys([*(p for s in self._segments(g).values() for p in s["parts"]), g])
        return list(dict.fromkeys(n for p in parts for n in self.damaged(p)))

    def damaged(self, generation: str) -> list[str]:
        """Names of tables that differ from their manifest among those written with a generation."""
        return [n for n, s in self.manifest(generation)["tables"].items() if table_digest(self.part(n, generation)) != s]

    def rollback(self) -> str:
        """Back to the current generation's parent; to the one pointed to before where the current manifest cannot be read."""
        number, now = self._now()
        try:
            parent = self.manifest(now)["parent"]
        except ValueError:
            older = (self._whole(f"pointers/{n:012d}.json") for n in reversed(self._pointers()))
            parent = next((p["generation"] for p in older if p and p["generation"] != now), None)
        if not parent:
            raise ValueError("there is no earlier generation")
        self.manifest(parent)
        self._move(number, parent)
        return parent

    def generations(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and s.getPath().getName().startswith("gen-"))

    def prune(self, quarantine: bool = False) -> list[str]:
        """Delete what is neither current nor its parent, nor holds segments of them, or set it aside.

        A generation that is being written has no manifest and stays.
        """
        now = self.current()
        keep = {now, now and self.manifest(now)["parent"]}
        keep |= {p for g in keep if g and self._whole(f"{g}/manifest.json") for s in self._segments(g).values() for p in s["parts"]}
        gone = [g for g in self.generations() if g not in keep and self._whole(f"{g}/manifest.json")]
        for g in gone:
            if quarantine:
                self._fs.mkdirs(self._path(f"{self.root}/quarantine"))
                self._fs.rename(self._path(f"{self.root}/{g}"), self._path(f"{self.root}/quarantine/{g}"))
            else:
                self._fs.delete(self._path(f"{self.root}/{g}"), True)
        return gone

    @contextmanager
    def locked(self, owner: str, seconds: float = 3600.0) -> Iterator[None]:
        """One writer at a time: others are refused until it ends, or until its time is up.

        Pointers move by compare-and-swap in any case; the lock saves the work of a build that would lose.
        """
        name, token = "writer.lock.json", uuid.uuid4().hex
        held = self._whole(name)
        if held and held["until"] < time.time():
            self._fs.delete(self._path(f"{self.root}/{name}"), False)
        if not self._write(name, {"owner": owner, "token": token, "until": time.time() + seconds}):
            raise Conflict(f"{(self._whole(name) or {}).get('owner', 'another writer')} is writing")
        try:
            yield
        finally:
            if (self._whole(name) or {}).get("token") == token:
                self._fs.delete(self._path(f"{self.root}/{name}"), False)

    def staged(self, label: str, names: list[str]) -> dict[str, DataFrame | None]:
        """Tables set aside under a label by :meth:`stage`, as far as they are complete; None for the others."""
        marks = {n: self._whole(f"staging/{label}/{n}.json") for n in names}
        return {n: m and self.spark.read.schema(StructType.fromJson(json.loads(m["schema"]))).parquet(f"{self.root}/staging/{label}/{m['folder']}") for n, m in marks.items()}

    def stage(self, label: str, name: str, df: DataFrame) -> DataFrame:
        """Set a table aside; it counts once it is complete."""
        folder = f"{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/staging/{label}/{folder}")
        self._write(f"staging/{label}/{name}.json", {"folder": folder, "schema": df.schema.json()})
        return self.staged(label, [name])[name]

    def unstage(self) -> None:
        """Forget all that was set aside."""
        self._fs.delete(self._path(f"{self.root}/staging"), True)
