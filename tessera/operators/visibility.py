"""Which records a principal may see: one predicate that reaches the scan, always the first filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("default", "project", "reference", "history")


@dataclass(frozen=True)
class Scope:
    """A request's limits. Empty ``sources`` allow nothing; ``projects`` are checked where a record names one."""

    mode: str = "default"
    sources: Sequence[str] = ()
    projects: Sequence[str] = ()
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    after: datetime | None = None
    before: datetime | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        for p in (*self.include, *self.exclude):
            clean_prefix(p)


@dataclass(frozen=True)
class Principal:
    """What a caller may ask for at most."""

    modes: Sequence[str] = MODES
    sources: Sequence[str] = ()
    projects: Sequence[str] = ()
    include: Sequence[str] = field(default=())
    exclude: Sequence[str] = field(default=())

    def narrow(self, asked: Scope) -> Scope | None:
        """The request within these rights; None if nothing is left (to callers the same as no evidence)."""
        if asked.mode not in self.modes:
            return None
        sources = [s for s in asked.sources if s in set(self.sources)] if asked.sources else list(self.sources)
        projects = [p for p in asked.projects if p in set(self.projects)] if asked.projects else list(self.projects)
        if not sources:
            return None
        include = list(asked.include) or list(self.include)
        if self.include:
            bounds = [clean_prefix(p) for p in self.include]
            include = [p for p in include if any(clean_prefix(p) == b or clean_prefix(p).startswith(b + "/") for b in bounds)]
            if not include:
                return None
        return Scope(asked.mode, sources, projects, include, [*asked.exclude, *self.exclude], asked.after, asked.before)


def clean_prefix(p: str) -> str:
    """A relative path prefix with single slashes; absolute paths, ``..`` and NUL are refused."""
    parts = [x for x in p.replace("\\", "/").split("/") if x not in ("", ".")]
    if p.startswith(("/", "\\")) or "\0" in p or ".." in parts or (parts and ":" in parts[0]):
        raise ValueError(f"not a relative path: {p!r}")
    return "/".join(parts)


def mode_allows(scope: Column, mode: str) -> Column:
    """Default records always, others in their own mode; ``never`` never."""
    return F.coalesce((scope != "never") & ((scope == "default") | (scope == mode)), F.lit(False))


def path_allowed(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Under any included prefix (all, if there are none) and under no excluded one, at segment bounds."""

    def under(prefixes: Sequence[str]) -> Column:
        found = F.lit(False)
        for p in map(clean_prefix, prefixes):
            found = found | (path == p) | path.startswith(p + "/") if p else F.lit(True)
        return found

    safe = path.isNotNull() & ~path.rlike(r"^[/\\]|(^|/)\.\.(/|$)|\x00")
    return safe & (under(include) if include else F.lit(True)) & ~under(exclude)


def within(modified: Column, after: datetime | None, before: datetime | None) -> Column:
    """Inclusive time bounds; an unknown time fails any bound."""
    ok = F.lit(True)
    if after is not None:
        ok = ok & (modified >= F.lit(after))
    if before is not None:
        ok = ok & (modified <= F.lit(before))
    return F.coalesce(ok, F.lit(False))


def visible(scope: Scope) -> Column:
    """The predicate of a scope over records; fails closed on nulls."""
    source = F.col("source_id").isin(list(scope.sources)) if scope.sources else F.lit(False)
    project = F.when(F.col("project_id").isNull(), F.col("retrieval_scope") != "project").otherwise(F.col("project_id").isin(list(scope.projects)) if scope.projects else F.lit(False))
    return mode_allows(F.col("retrieval_scope"), scope.mode) & F.coalesce(source, F.lit(False)) & F.coalesce(project, F.lit(False)) & path_allowed(F.col("path"), scope.include, scope.exclude) & within(F.col("modified_at"), scope.after, scope.before)


def visible_records(records: DataFrame, scope: Scope) -> DataFrame:
    return records.where(visible(scope))


def status_counts(records: DataFrame, principal: Principal) -> DataFrame:
    """Visible records and documents per source, over all modes of a principal."""
    if not principal.sources or not principal.modes:
        seen = records.where(F.lit(False))
    else:
        any_mode = F.lit(False)
        for m in principal.modes:
            any_mode = any_mode | visible(Scope(m, principal.sources, principal.projects, principal.include, principal.exclude))
        seen = records.where(any_mode)
    return seen.groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("document_id").alias("documents"))
