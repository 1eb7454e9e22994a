"""Topic manifests and source configurations: JSON that is read, checked, and turned into small tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where a manifest is missing or wrong.
DEFAULT_MANIFEST = {
    "version": 1,
    "themes": [
        {"key": "engineering", "label": "Engineering", "color": "#2563EB", "topics": [{"key": "data", "label": "Data systems", "terms": ["database", "index", "query"]}, {"key": "software", "label": "Software", "terms": ["code", "release", "test"]}]},
        {"key": "research", "label": "Research", "color": "#16A34A", "topics": [{"key": "method", "label": "Methods", "terms": ["experiment", "method", "sample"]}]},
    ],
}


def check_manifest(value: object) -> str | None:
    """What is wrong with a manifest; None if nothing is."""
    if not isinstance(value, dict) or not isinstance(value.get("themes"), list):
        return "themes must be a list"
    themes, topics = set(), set()
    for theme in value["themes"]:
        key, label, color = (str(theme.get(k) or "").strip() for k in ("key", "label", "color"))
        if not key or not label or not re.fullmatch("#[0-9A-Fa-f]{6}", color):
            return "each theme needs a key, a label and a #RRGGBB color"
        if key in themes:
            return f"duplicate theme {key}"
        themes.add(key)
        for topic in theme.get("topics") or []:
            name, text = (str(topic.get(k) or "").strip() for k in ("key", "label"))
            if not name or not text or (topic.get("color") is not None and not re.fullmatch("#[0-9A-Fa-f]{6}", str(topic["color"]).strip())):
                return f"invalid topic in theme {key}"
            if name in topics:
                return f"duplicate topic {name}"
            topics.add(name)
    return None if themes and topics else "a manifest needs a theme and a topic"


def topics_table(spark: SparkSession, text: str | None) -> tuple[DataFrame, str | None]:
    """(theme, theme_label, theme_color, topic, label, color, terms, context_only) of a manifest's text, and a warning if defaults stand in."""
    warning = None
    try:
        value = json.loads(text) if text else None
        warning = check_manifest(value) if text else "no manifest"
    except ValueError as e:
        warning = f"not JSON: {e}"
    value = DEFAULT_MANIFEST if warning else value
    rows = [
        (t["key"], t["label"], t["color"].upper(), p["key"], p["label"], (p.get("color") or "").upper() or None, [str(x).lower() for x in p.get("terms") or []], p.get("context_only") is True)
        for t in value["themes"] for p in t.get("topics") or []
    ]
    schema = "theme string, theme_label string, theme_color string, topic string, label string, color string, terms array<string>, context_only boolean"
    return spark.createDataFrame(rows, schema), warning


def topic_scores(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, theme, topic, score) of topics with a score of 1 or more; a tag named after the topic adds 12.

    The topic table comes from a manifest: all its terms are compiled into one matcher, which reads each document once.
    Topics that are ``context_only`` take no part.
    """
    from tessera.functions import terms, text

    searchable = F.lower(F.concat_ws(" ", "title", F.array_join("tags", " "), "content"))
    side = F.coalesce("context_only", F.lit(False)) if "context_only" in topics.columns else F.lit(False)
    table = topics.where(~side).select("theme", "topic", "terms").collect()  # a manifest's topics
    told = [F.struct(F.lit(t["theme"]).alias("theme"), F.lit(t["topic"]).alias("topic"), F.lit(f"knowledge point {t['topic']}".replace("-", " ")).alias("tag")) for t in table]
    named = F.transform("tags", lambda x: text.normalize(F.replace(x, F.lit("-"), F.lit(" "))))
    rows = docs.select("id", named.alias("_tags"), terms.weighed(searchable, F.lit(""), [t["terms"] or [] for t in table], 0).alias("_w"))
    kind = "array<struct<theme:string,topic:string,tag:string>>"

    def entry(t: Column, i: Column) -> Column:
        score = F.get("_w.scores", i) + F.when(F.array_contains("_tags", t["tag"]), 12.0).otherwise(0.0)
        return F.struct(t["theme"].alias("theme"), t["topic"].alias("topic"), score.alias("score"))

    scored = F.filter(F.transform(F.array(*told).cast(kind), entry), lambda e: e["score"] >= 1)
    return rows.select("id", F.inline(scored))


def assign_topics(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, theme, topic): the best topic of each document, ties by key; null where none scores."""
    best = topic_scores(docs, topics).groupBy("id").agg(F.min_by(F.struct("theme", "topic"), F.struct(-F.col("score"), F.col("topic"))).alias("b"))
    return docs.select("id").join(best, "id", "left").select("id", "b.theme", "b.topic")


@dataclass(frozen=True)
class Source:
    id: str
    root: str
    scope: str | None = None
    project: str | None = None


def sources(text: str) -> list[Source]:
    """1 to 16 sources with unique ids, roots that do not overlap, and known fields only."""
    raw = json.loads(text)
    if not isinstance(raw, list) or not 1 <= len(raw) <= 16:
        raise ValueError("expected 1 to 16 sources")
    out = []
    for r in raw:
        extra = set(r) - {"id", "root", "scope", "project"}
        if extra or not r.get("id") or not r.get("root"):
            raise ValueError(f"invalid source: {sorted(extra) or 'id and root are needed'}")
        out.append(Source(str(r["id"]), str(r["root"]).rstrip("/"), r.get("scope"), r.get("project")))
    if len({s.id for s in out}) < len(out):
        raise ValueError("source ids must be unique")
    for a in out:
        for b in out:
            if a is not b and (a.root + "/").startswith(b.root + "/"):
                raise ValueError(f"roots overlap: {a.root}, {b.root}")
    return out
