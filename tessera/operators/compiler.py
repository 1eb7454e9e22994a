"""Builds: scan, plan, reuse, compile, check again, publish; of one source or of many, and engines that follow them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import embedding, ids
from tessera.functions.text import nfc
from tessera.operators import catalog, channels, segments
from tessera.operators.writes import Ledger
from tessera.sources import markdown
from tessera.sources.settings import BuildPolicy, isolated
from tessera.sources.store import Conflict, Segmented, Store

VERSION = "1"


class SourceChanged(RuntimeError):
    """The source changed while it was compiled."""


class SourceRefused(ValueError):
    """The source breaks its policy: too many files, one too large, or two with one path."""


@dataclass(frozen=True)
class Report:
    """What a build did; ``published`` is false where the current generation already says it all."""

    generation: str
    published: bool
    compiled: int
    reused: int
    tombstones: int
    duplicates: int
    compacted: bool
    resumed: int = 0


#: Tables that a generation keeps in segments. Documents also follow their files' times, the others only their contents.
SEGMENTED = {
    "units": Segmented("path", "gone_paths"), "documents": Segmented("ordinal", "gone_documents"), "chunks": Segmented("ordinal", "gone_ordinals"),
    "chunk_postings": Segmented("ordinal", "gone_ordinals"), "postings": Segmented("id", "gone_ordinals"), "hierarchy": Segmented("ordinal", "gone_ordinals"),
    "vectors": Segmented("ordinal", "gone_ordinals"),
}


@dataclass
class Compiler:
    """Compiles one source folder into generations of a store.

    The scan gives paths and hashes; only files that are new or changed are read on, parsed, cut and embedded. What they
    give is published as a delta over the segments of the generations before: their rows, and the paths and ordinals
    that are replaced. When there are too many deltas, or they replace too much, the merged rows become a new base. A
    new policy (or adapter, or version) compiles everything.

    Fresh units are set aside in batches under the plan's hash, so a build that broke off goes on with what is left. A
    build holds the store's lock; the source is hashed again before publishing, and a build whose source changed
    meanwhile is thrown away. ``read`` replaces the scan.
    """

    spark: SparkSession
    source: str
    root: str
    store: Store
    policy: BuildPolicy = field(default_factory=BuildPolicy)
    adapter: embedding.Adapter | None = None
    journal: Ledger = field(default_factory=Ledger)
    read: Callable[[], DataFrame] | None = None
    batch: int = 50_000

    def __post_init__(self) -> None:
        isolated(self.store.root.removeprefix("file://"), [self.root])

    def scan(self) -> DataFrame:
        """All files that the policy's folders leave, whatever their size."""
        return self.read() if self.read else markdown.scan(self.spark, self.root, self.policy.ignored, 1 << 62)

    @property
    def policy_hash(self) -> str:
        return self.policy.hash(self.source, embedding.contract(self.adapter) if self.adapter else None, VERSION)

    def _previous(self) -> tuple[str | None, dict | None, dict[str, DataFrame]]:
        """The current generation with its note and tables, where what it wrote is whole; a base is also checked for sense."""
        now = self.store.current()
        if now is None:
            return None, None, {}
        manifest = self.store.manifest(now)
        gone = {d.gone for d in SEGMENTED.values()}
        tables = {name: self.store.read(name, now) for name in manifest["tables"] if name not in gone}
        sound = not self.store.damaged(now) and (bool(manifest.get("segments")) or catalog.faults(tables).isEmpty())
        return now, (manifest["note"] if sound else None), (tables if sound else {})

    def build(self, compact: bool = False, now: datetime | None = None) -> Report:
        """One build; a second writer is refused, and one who publishes first makes this one fail without a trace."""
        with self.store.locked(self.source):
            return self._build(compact, now or datetime.now(timezone.utc).replace(tzinfo=None))

    def _build(self, compact: bool, now: datetime) -> Report:
        files, plan = self._files()
        try:
            current, note, tables = self._previous()
            same = note is not None and note["policy"] == self.policy_hash
            deltas = (note or {}).get("deltas", 0)
            self._log("scan-started", plan)
            if same and note["plan"] == plan and not (compact and deltas):
                self._unchanged(plan)
                self._log("scan-completed", plan, current)
                return Report(current, False, 0, files.count(), 0, catalog.bundle_statistics(tables["catalog"]).first()["duplicates"], False)
            before = tables["catalog"] if tables else self.spark.createDataFrame([], catalog.CATALOG)
            todo, kept = catalog.reusable(files, tables["units"], same) if tables else (files, None)
            fresh, compiled, resumed = self._compiled(todo.select("path"), plan)
            units = fresh if kept is None else fresh.unionByName(kept.select(*fresh.columns))
            following = self.store.stage(plan, f"catalog-{uuid.uuid4().hex[:8]}", catalog.next_catalog(units, before, now))
            replaced = catalog.replaced_ordinals(before, following).persist()
            counts = catalog.bundle_statistics(following).first()
            n_replaced = replaced.count()
            compacted = not same or compact or segments.due(deltas + 1, n_replaced, counts["active_documents"], self.policy.most_deltas, self.policy.most_replaced)
            once = uuid.uuid4().hex[:8]
            keep = lambda name, df: self.store.stage(plan, f"{name}-{once}", df)
            layers = self._layers(units, fresh, before, following, replaced, tables, keep) if same else self._whole(units, following, keep)
            if same and compacted:
                layers = self._merged(layers, tables)
            told = {"policy": self.policy_hash, "plan": plan, "deltas": 0 if compacted else deltas + 1, "source": self.source, "embedding": embedding.contract(self.adapter) if self.adapter else None}
            self._unchanged(plan)
            generation = self.store.publish(layers, expected=current, note=told, deltas=None if compacted else {n: d for n, d in SEGMENTED.items() if n in layers})
            self.store.unstage()
            self._log("generation-published", plan, generation)
            self.journal.compact(self.policy.journal)
            replaced.unpersist()
            reused = files.where("valid_utf8").count() - compiled
            return Report(generation, True, compiled, reused, counts["tombstones"], counts["duplicates"], compacted, resumed)
        finally:
            files.unpersist()

    def _scanned(self) -> DataFrame:
        return self.scan().withColumn("content_sha256", F.coalesce("content_sha256", F.lit("")))

    def _files(self, attempts: int = 3) -> tuple[DataFrame, str]:
        """What is known of each file but its text, kept in the session, and its plan's hash; the source is read once for both."""
        listed = self.scan().select("path", "byte_length")  # reads no contents
        most = listed.agg(F.count(F.lit(1)).alias("files"), F.max("byte_length").alias("bytes")).first()
        if most["files"] > self.policy.most_files:
            raise SourceRefused(f"{most['files']} files, more than {self.policy.most_files}")
        if (most["bytes"] or 0) > self.policy.most_bytes:
            large = listed.where(F.col("byte_length") > self.policy.most_bytes).agg(F.min("path")).first()[0]
            raise SourceRefused(f"{large} is larger than {self.policy.most_bytes} bytes")
        twice = listed.groupBy(nfc(F.col("path")).alias("p")).count().where("count > 1").first()
        if twice:
            raise SourceRefused(f"two files are named {twice['p']}")
        for left in reversed(range(attempts)):
            # the check at the end reads the source again: it has no columns in common with this plan but the scan's
            seen = self._scanned()
            torn = F.col("read_bytes") != F.col("byte_length") if "read_bytes" in seen.columns else F.lit(False)
            files = seen.select("path", "content_sha256", "norm_sha256", "byte_length", "mtime", "valid_utf8", torn.alias("torn")).persist()
            if files.where("torn").isEmpty():
                return files, ids.digest([self.policy_hash, markdown.plan_hash(files)])
            files.unpersist()
        raise SourceChanged(f"a file of {self.source} changes while it is read")

    def _compiled(self, paths: DataFrame, plan: str) -> tuple[DataFrame, int, int]:
        """The units of some files, their number, and how many of them were set aside by a build that broke off.

        The batches of a plan are told by its hash and by what is compiled under it, so other files never meet them.
        """
        n = paths.count()
        batches = max(1, -(-n // self.batch))
        names = [f"units-{markdown.path_digest(paths)}-{k}-of-{batches}" for k in range(batches)]
        done = self.store.staged(plan, names)
        resumed = sum(df.count() for df in done.values() if df is not None)
        few = None
        if n <= 10_000 and not self.read:  # a few files are opened by name, not found by reading all
            few = [r["path"] for r in paths.collect()]
            few = few if all(markdown.PLAIN.fullmatch(p) for p in few) else None
        for k, name in enumerate(names):
            if done[name] is None:
                mine = F.pmod(F.xxhash64("path"), F.lit(batches)) == k
                found = self._scanned() if few is None else markdown.scan(self.spark, self.root, self.policy.ignored, 1 << 62, only=few).withColumn("content_sha256", F.coalesce("content_sha256", F.lit("")))
                found = found.drop("read_bytes").join(paths.where(mine), "path", "left_semi")
                done[name] = self.store.stage(plan, name, catalog.compile_notes(found, self.source))
        units = reduce(DataFrame.unionByName, done.values())
        return units, units.count(), resumed

    def _whole(self, units: DataFrame, following: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
        layers = catalog.layers(units, following, self.policy.chunk, self.policy.overlap, keep) | {"units": units}
        return layers | ({"vectors": self._vectors(layers, None)} if self.adapter else {})

    def _layers(
        self,
        units: DataFrame,
        fresh: DataFrame,
        before: DataFrame,
        following: DataFrame,
        replaced: DataFrame,
        tables: dict[str, DataFrame],
        keep: Callable[[str, DataFrame], DataFrame],
    ) -> dict[str, DataFrame]:
        """The rows of notes that came or changed, and the keys of earlier rows that no longer count."""
        moved = keep("moved", catalog.replaced_ordinals(before, following, "mtime", "corpus", "retrieval_scope"))
        of = lambda df, keys: df.join(following.where(catalog.ACTIVE).join(keys, F.col("ordinal") == F.col("id"), "left_semi").select("path"), "path", "left_semi")
        own = keep("own", of(units, moved))
        layers = catalog.layers(of(own, replaced), following, self.policy.chunk, self.policy.overlap, keep)
        layers["documents"] = catalog.layers(own, following, self.policy.chunk, self.policy.overlap)["documents"]
        layers["units"] = fresh
        if self.adapter:
            layers["vectors"] = self._vectors(layers, tables.get("vectors"))
        left = tables["units"].select("path").join(units.select("path"), "path", "left_anti")
        key = F.col("id").alias("key")
        return layers | {"gone_paths": fresh.select(F.col("path").alias("key")).unionByName(left.select(F.col("path").alias("key"))), "gone_ordinals": replaced.select(key), "gone_documents": moved.select(key)}

    def _merged(self, layers: dict[str, DataFrame], tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Whole tables from the earlier ones and a delta."""
        gone = {d.gone for d in SEGMENTED.values()}
        join = lambda n, d: segments.merged([(tables[n].select(*layers[n].columns), None), (layers[n], layers[d.gone])], d.key, "key")
        return {n: join(n, SEGMENTED[n]) if n in SEGMENTED else df for n, df in layers.items() if n not in gone}

    def _vectors(self, layers: dict[str, DataFrame], known: DataFrame | None) -> DataFrame:
        """(id, ordinal, text_sha256, values) of chunks; a note's chunk whose text had a vector before keeps it."""
        documents = layers["documents"].select("path", "title", "aliases", "tags")
        records = layers["chunks"].join(documents, "path").withColumn("id", F.col("chunk_id"))
        own = records.select("id", "ordinal", channels.search_text(records).alias("text"))
        own = own.withColumn("text_sha256", F.sha2("text", 256))
        if known is None:
            return own.select("id", "ordinal", "text_sha256", embedding.embedded(F.col("text"), self.adapter).alias("values"))
        had = known.groupBy("ordinal", "text_sha256").agg(F.first("values").alias("values"))
        own = own.join(had, ["ordinal", "text_sha256"], "left")
        new = own.where("values is null").select("id", "ordinal", "text_sha256", embedding.embedded(F.col("text"), self.adapter).alias("values"))
        return own.where("values is not null").select("id", "ordinal", "text_sha256", "values").unionByName(new)

    def _unchanged(self, plan: str) -> None:
        if ids.digest([self.policy_hash, markdown.plan_hash(self._scanned())]) != plan:
            raise SourceChanged(f"{self.source} changed during the build")

    def _log(self, kind: str, plan: str, generation: str | None = None) -> None:
        self.journal.append({"kind": kind, "plan": plan, "generation": generation})


class RuntimeCatalog:
    """Which generation of each source is served: one checked entry, moved by compare-and-swap."""

    def __init__(self, spark: SparkSession, root: str):
        self._store = Store(spark, root)

    def read(self, embedding_contract: dict | None = None) -> tuple[str | None, dict | None]:
        """(checksum, entry) of what is served; an entry for another embedding contract is an error."""
        name = self._store.current()
        if name is None:
            return None, None
        entry = self._store.manifest(name)["note"]
        if entry.get("schema") != 1:
            raise ValueError("the catalog has another schema")
        if embedding_contract is not None and entry["embedding"] != embedding_contract:
            raise ValueError("the catalog was made for another embedding")
        return ids.digest(entry), entry

    def publish(self, pins: Mapping[str, str], expected: str | None, owner: str, embedding_contract: dict | None = None) -> str:
        """Serve the pinned generations (by source) if the catalog is still as ``expected``; the same pins again change nothing."""
        checksum, entry = self.read()
        body = {"schema": 1, "owner": owner, "embedding": embedding_contract, "pins": dict(sorted(pins.items()))}
        if entry == body:
            return checksum
        if checksum != expected:
            raise Conflict("the catalog was published meanwhile")
        if entry and entry["owner"] != owner:
            raise PermissionError("the catalog belongs to another deployment")
        self._store.publish({}, expected=self._store.current(), note=body)
        return ids.digest(body)


def build_all(compilers: Sequence[Compiler], runtime: RuntimeCatalog, owner: str = "tessera") -> tuple[dict[str, Report], str]:
    """Build sources one after the other, then serve all of their generations at once; none if one fails."""
    if len({c.source for c in compilers}) < len(compilers):
        raise ValueError("sources must be different")
    expected, _ = runtime.read()
    contracts = [embedding.contract(c.adapter) if c.adapter else None for c in compilers]
    if any(c != contracts[0] for c in contracts):
        raise ValueError("all sources need one embedding")
    reports = {c.source: c.build() for c in compilers}
    return reports, runtime.publish({s: r.generation for s, r in reports.items()}, expected, owner, contracts[0] if contracts else None)


class Served:
    """An engine over the pinned generations; :meth:`reload` swaps it in one step, and readers keep the one they have."""

    def __init__(self, stores: Mapping[str, Store], runtime: RuntimeCatalog, make: Callable[[dict[str, DataFrame]], object]):
        self._stores, self._runtime, self._make = dict(stores), runtime, make
        self.checksum: str | None = None
        self.engine: object | None = None

    def reload(self) -> bool:
        """Whether something new is served; if loading fails, the old engine stays."""
        checksum, entry = self._runtime.read()
        if entry is None or checksum == self.checksum:
            return False
        records = {}
        for source, generation in entry["pins"].items():
            store = self._stores[source]
            if store.verify(generation):
                raise ValueError(f"generation {generation} of {source} is damaged")
            held = {n: store.read(n, generation) for n in ("catalog", "documents", "chunks", "temporal", "hierarchy", "postings")}
            wrong = catalog.faults(held).collect()  # a row for each check that fails
            if wrong:
                raise ValueError(f"generation {generation} of {source}: {', '.join(r['check'] for r in wrong)}")
            chunks, docs = held["chunks"], held["documents"]
            records[source] = chunks.select(F.col("chunk_id").alias("id"), "path", "heading", "content").join(docs.select("path", "title", "aliases", "tags", "corpus", "retrieval_scope", F.col("mtime").alias("modified_at")), "path")
        self.engine, self.checksum = self._make(records), checksum
        return True


@dataclass(frozen=True)
class Snapshot:
    """A saved index and what became of it: ``loaded``, ``repaired`` (was missing or stale), or ``degraded`` (not saved)."""

    tables: dict[str, DataFrame]
    status: str


def snapshot(store: Store, key: Mapping[str, object], make: Callable[[], dict[str, DataFrame]], save: bool = True) -> Snapshot:
    """The saved tables if they were made for just this key (version, fingerprint, mode, source state) and are whole, else new ones."""
    want, now = ids.digest(dict(key)), store.current()
    try:
        if now and store.manifest(now)["note"].get("key") == want and not store.verify(now):
            return Snapshot({n: store.read(n, now) for n in store.manifest(now)["tables"]}, "loaded")
    except Exception:  # a damaged snapshot is made anew
        pass
    tables = make()
    if not save:
        return Snapshot(tables, "degraded")
    try:
        generation = store.publish(tables, expected=now, note={"key": want})
    except (Conflict, OSError):
        return Snapshot(tables, "degraded")
    return Snapshot({n: store.read(n, generation) for n in tables}, "repaired")
