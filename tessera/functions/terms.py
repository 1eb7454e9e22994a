"""Many lists of terms weighed in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import in_slices

MOST = 4  # occurrences of a term that count
EVIDENCE = 8
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

_SHAPE = "struct<scores:array<double>,evidence:array<array<string>>>"


class Matcher:
    """A trie of all distinct terms with failure links; a text is read once, however many lists there are."""

    def __init__(self, groups: Sequence[Sequence[str]]) -> None:
        places: dict[str, int] = {}
        self.groups = [[places.setdefault(t, len(places)) for t in terms if t] for terms in groups]
        self.terms = list(places)
        self.ascii = [t.isascii() for t in self.terms]
        self.weight = [1.35 if " " in t or len(t) >= 4 else 1.0 for t in self.terms]
        self.of: list[list[int]] = [[] for _ in self.terms]
        for g, ids in enumerate(self.groups):
            for i in dict.fromkeys(ids):
                self.of[i].append(g)
        self.trie = ahocorasick.Automaton()
        for t, i in places.items():
            self.trie.add_word(t, i)
        if places:
            self.trie.make_automaton()

    def counts(self, text: str) -> dict[int, int]:
        """Occurrences by term, at most ``MOST``; an ASCII term stands alone, and one's own occurrences don't overlap."""
        found: dict[int, int] = {}
        after: dict[int, int] = {}
        if not self.terms:
            return found
        end = len(text)
        for last, i in self.trie.iter(text):
            start = last + 1 - len(self.terms[i])
            if found.get(i, 0) == MOST or start < after.get(i, 0):
                continue
            if self.ascii[i] and ((start and text[start - 1] in WORD) or (last + 1 < end and text[last + 1] in WORD)):
                continue
            found[i] = found.get(i, 0) + 1
            after[i] = last + 1
        return found

    def scores(self, text: str) -> list[float]:
        """By list, the sum of its terms' weights, in the order of the list."""
        found = self.counts(text)
        out = [0.0] * len(self.groups)
        for g in {g for i in found for g in self.of[i]}:
            for i in self.groups[g]:
                if i in found:
                    out[g] += self.weight[i] * (1 + 0.35 * (found[i] - 1))
        return out

    def evidence(self, text: str, lists: int) -> list[list[str]]:
        """By list, of the first ``lists``: up to ``EVIDENCE`` of its terms that the text holds anywhere."""
        held = {i for _, i in self.trie.iter(text)} if self.terms else set()
        out: list[list[str]] = [[] for _ in range(lists)]
        for g in {g for i in held for g in self.of[i] if g < lists}:
            out[g] = [self.terms[i] for i in self.groups[g] if i in held][:EVIDENCE]
        return out


@lru_cache(maxsize=8)
def _matcher(groups: tuple[tuple[str, ...], ...]) -> Matcher:
    return Matcher(groups)


def weighed(text: Column, whole: Column, groups: Sequence[Sequence[str]], lists: int) -> Column:
    """(scores, evidence) of lower-case texts: by list of terms the sum of ``text.term_weight``, and of the first
    ``lists`` lists the terms that ``whole`` holds. A null text scores 0; empty terms count nowhere.
    """
    fixed = tuple(tuple(g) for g in groups)

    @F.arrow_udf(_SHAPE)
    def f(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = _matcher(fixed)
        for s, w in batches:
            parts = []
            for at in in_slices(len(s)):
                scores = pa.array([m.scores(x or "") for x in s[at].to_pylist()], pa.list_(pa.float64()))
                evidence = pa.array([m.evidence(x or "", lists) for x in w[at].to_pylist()], pa.list_(pa.list_(pa.string())))
                parts.append(pa.StructArray.from_arrays([scores, evidence], ["scores", "evidence"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct({"scores": pa.list_(pa.float64()), "evidence": pa.list_(pa.list_(pa.string()))}))

    return f(text, whole)
