"""Embedding adapters: what turns texts into vectors, as a column, for a query, or for a whole build.

An adapter is told by its id, model, kind and dimension; vectors of two builds meet only where these are the same.
Every vector that an adapter returns is checked: right length, finite components, bounded norm.
"""

from __future__ import annotations

import json
import math
import re
import urllib.request
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import FNV_PRIME, FNV_SEED

KINDS = ("lexical_hash", "semantic")
#: What of a record is embedded; part of a build's contract.
RECIPE = "title-heading-aliases-tags-hierarchy-content"
BATCH = 64
MOST_NORM_SQUARED = 1e12


class Adapter(Protocol):
    id: str
    model: str
    kind: str
    dims: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def contract(adapter: Adapter) -> dict:
    """What must be equal for vectors to be comparable."""
    return {"adapter": adapter.id, "model": adapter.model, "kind": adapter.kind, "dims": adapter.dims, "recipe": RECIPE}


def checked(vectors: Sequence[Sequence[float]], count: int, dims: int) -> list[list[float]]:
    """The vectors, if there are ``count`` of them and each is safe."""
    if len(vectors) != count:
        raise ValueError("the adapter returned another number of vectors")
    for v in vectors:
        if len(v) != dims or not all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) or sum(x * x for x in v) > MOST_NORM_SQUARED:
            raise ValueError("the adapter returned a malformed vector")
    return [list(map(float, v)) for v in vectors]


def _fnv(s: str, seed: int = FNV_SEED) -> int:
    h = seed
    for c in s:
        h = ((h ^ ord(c)) * FNV_PRIME) & 0xFFFFFFFF
    return h


@dataclass(frozen=True)
class HashAdapter:
    """Signed feature hashing of a text's tokens, ``1 + ln tf`` each, to unit length; needs no model."""

    dims: int = 384
    id: str = "feature-hash-v1"
    model: str = "feature-hash"
    kind: str = "lexical_hash"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        from tessera.operators.selection import tokens

        out = []
        for t in texts:
            counts: dict[str, int] = {}
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
            v = [0.0] * self.dims
            for w, n in counts.items():
                v[_fnv(w) % self.dims] += (1.0 if _fnv(w, 2654435769) % 2 == 0 else -1.0) * (1 + math.log(n))
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out


@dataclass(frozen=True)
class LoopbackAdapter:
    """A model server on this machine, asked over its embeddings endpoint; answers are bounded in size and checked."""

    port: int
    model: str
    dims: int
    most_bytes: int = 32 << 20
    timeout: float = 30.0
    kind: str = "semantic"

    def __post_init__(self) -> None:
        if not 1024 <= self.port <= 65535 or self.dims < 1 or self.most_bytes < 1024 or not re.fullmatch(r"[\w./:-]{1,160}", self.model):
            raise ValueError("the port, dimension, size limit or model name is not valid")

    @property
    def id(self) -> str:
        return f"loopback:{self.model}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": list(texts)}).encode()
        asked = urllib.request.Request(f"http://127.0.0.1:{self.port}/v1/embeddings", body, {"content-type": "application/json"})
        # no proxies and no redirects: nothing may leave the machine
        opener = urllib.request.build_opener(urllib.request.ProxyHandler({}), _NoRedirect())
        with opener.open(asked, timeout=self.timeout) as answer:
            raw = answer.read(self.most_bytes + 1)
        if len(raw) > self.most_bytes:
            raise ValueError("the answer is too large")
        data = json.loads(raw).get("data")
        found = {d["index"]: d["embedding"] for d in data or []}
        if len(data or []) != len(texts) or sorted(found) != list(range(len(texts))):
            raise ValueError("the answer's indexes are not those of the request")
        return [found[i] for i in range(len(texts))]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        raise ValueError("the server redirects")


def select_adapter(settings: Mapping[str, str]) -> Adapter:
    """The adapter that settings name: ``EMBEDDING`` is hash (the default) or loopback with port, model and dimension."""
    kind = settings.get("EMBEDDING", "hash").strip()
    dims = int(settings.get("EMBEDDING_DIMS") or 384)
    if kind == "hash":
        if not 16 <= dims <= 4096:
            raise ValueError("EMBEDDING_DIMS must lie in 16 to 4096")
        return HashAdapter(dims)
    if kind == "loopback":
        if not settings.get("EMBEDDING_PORT") or not settings.get("EMBEDDING_MODEL") or not settings.get("EMBEDDING_DIMS"):
            raise ValueError("a loopback embedding needs EMBEDDING_PORT, EMBEDDING_MODEL and EMBEDDING_DIMS")
        return LoopbackAdapter(int(settings["EMBEDDING_PORT"]), settings["EMBEDDING_MODEL"], dims)
    raise ValueError(f"unknown embedding {kind}")


def embedded(c: Column, adapter: Adapter) -> Column:
    """A text column's vectors, asked for in batches; null texts have none."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            known = s.notna()
            texts, got = s[known].tolist(), []
            for at in range(0, len(texts), BATCH):
                some = texts[at : at + BATCH]
                got += checked(adapter.embed(some), len(some), adapter.dims)
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            out[known] = pd.Series(got, index=s.index[known], dtype=object)
            yield out

    return run(c)


def record_vectors(records: DataFrame, adapter: Adapter) -> DataFrame:
    """(id, values) of records by their search text, for a build."""
    from tessera.operators.channels import search_text

    return records.select("id", embedded(search_text(records), adapter).alias("values"))


def query_vector(text: str, adapter: Adapter) -> list[float]:
    return checked(adapter.embed([text]), 1, adapter.dims)[0]
