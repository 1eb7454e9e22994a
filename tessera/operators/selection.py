"""Choosing evidence among at most a few hundred fused candidates of a query.

The candidates of one query are bounded by the channels' limits, so the sequential steps run on one group; many
queries run as groups in parallel.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEAR_DUPLICATE = 0.92
MMR_LAMBDA = 0.72
_CJK = re.compile("[぀-ヿ㐀-鿿豈-﫿가-힯ᄀ-ᇿ\U00020000-\U0003134f]")
_SENTENCE = re.compile("[^.!?。！？\n]+[.!?。！？]?")


def normalize(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).lower().split())


def tokens(value: str) -> list[str]:
    """The words of :func:`tessera.functions.text.tokens`, for single texts."""
    out: list[str] = []
    for word in re.findall(r"[^\W_]+", normalize(value)):
        out.append(word)
        if _CJK.search(word):
            out += list(word) + [word[i : i + 2] for i in range(len(word) - 1)]
    return out


def shingle_set(value: str, width: int = 3) -> set[tuple[str, ...]]:
    words = tokens(value)
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def similarity(a: set, b: set) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def select(contents: Sequence[str], scores: Sequence[float], limit: int, near: float = NEAR_DUPLICATE, trade: float = MMR_LAMBDA) -> list[int]:
    """Places of the chosen candidates: near duplicates of kept earlier ones go, then maximal marginal relevance."""
    sets = [shingle_set(c) for c in contents]
    kept: list[int] = []
    for i in range(len(contents)):
        if all(similarity(sets[i], sets[j]) < near for j in kept):
            kept.append(i)
    low, high = min([0.0, *scores]), max([0.0, *scores])
    worth = {i: (scores[i] - low) / (high - low) if high > low else 0.0 for i in kept}
    chosen: list[int] = []
    nearest = dict.fromkeys(kept, 0.0)
    while kept and len(chosen) < limit:
        best = max(kept, key=lambda i: (trade * worth[i] - (1 - trade) * nearest[i], -i))
        chosen.append(best)
        kept.remove(best)
        for i in kept:
            nearest[i] = max(nearest[i], similarity(sets[i], sets[best]))
    return chosen


def compress(content: str, query: str, most: int) -> tuple[str, bool]:
    """Source sentences that cover the query best within ``most`` characters, in their order; whether it was cut."""
    most = max(1, int(most))
    if len(content) <= most:
        return content, False
    wanted = set(tokens(query))
    found = []
    for i, m in enumerate(_SENTENCE.finditer(content)):
        s = m.group().strip()
        if s:
            found.append((-(len(wanted & set(tokens(s))) / len(wanted)) if wanted else 0.0, i, s))
    picked, used = [], 0
    for score, i, s in sorted(found):
        extra = len(s) + (3 if picked else 0)
        if used + extra <= most:
            picked.append((i, s))
            used += extra
    if not picked:
        return content[:most], True
    out = " … ".join(s for _, s in sorted(picked))[:most]
    return out, normalize(out) != normalize(content)


def select_groups(candidates: DataFrame, limit: int, near: float = NEAR_DUPLICATE, trade: float = MMR_LAMBDA) -> DataFrame:
    """(query_id, id, pick) of the chosen candidates of each query; input (query_id, id, content, score), bounded per query."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        chosen = select([c or "" for c in pdf["content"]], pdf["score"].tolist(), limit, near, trade)
        out = pdf.loc[chosen, ["query_id", "id"]].reset_index(drop=True)
        out["pick"] = range(1, len(out) + 1)
        return out

    kind = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(run, f"query_id {kind['query_id']}, id {kind['id']}, pick int")


def compress_column(df: DataFrame, content: str, query: str, most: int) -> DataFrame:
    """Adds ``excerpt`` and ``compressed``."""

    @F.pandas_udf("excerpt string, compressed boolean")
    def f(s: pd.Series) -> pd.DataFrame:
        got = [compress(x or "", query, most) for x in s]
        return pd.DataFrame(got, columns=["excerpt", "compressed"])

    return df.withColumn("_e", f(F.col(content))).select(*df.columns, "_e.excerpt", "_e.compressed")
