"""Effective documents, topic groups and their labels, and display attributes of a document graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numeric, policy, text

# fixed values: names and weights
SYSTEM_FOLDERS = [".obsidian", ".agents", ".codex", ".git", ".github", "node_modules", "dist", "build", "generated", "_generated", ".cache", "cache", "tmp", ".trash"]
SYSTEM_NAMES = ["readme", "agents", "changelog", "license", "contributing", "security", "code_of_conduct"]
FIRST_WEIGHTS, COPY_WEIGHTS, SUPPORT_WEIGHTS = (0.86, 0.2), (0.36, 0.012), (0.3, 0.008)
STATUSES = ["ok", "degraded", "failed"]


def exclusion_reason(path: Column, content: Column, hidden: Column, hidden_reason: Column) -> Column:
    """Why a document has no place in the graph; null if it has one. The first rule that holds counts."""
    name = text.basename(path)
    base = F.regexp_replace(name, r"(?i)\.md$", "")
    norm = F.regexp_replace(text.normalize(F.regexp_replace(base, r"[-_]+", " ")), " ", "_")
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    body = text.strip_frontmatter(content)
    return (
        F.when(name.startswith("._"), "AppleDouble metadata")
        .when(F.coalesce(hidden, F.lit(False)), F.coalesce(hidden_reason, F.lit("frontmatter graph_exclude")))
        .when(F.arrays_overlap(folders, F.array(*map(F.lit, SYSTEM_FOLDERS))), "system or generated path")
        .when(norm.isin(SYSTEM_NAMES) | norm.contains("readme"), F.concat(base, F.lit(" document")))
        .when(~policy.has_body(body), "empty document")
        .when(policy.is_link_list(body), "link-only navigation document")
    )


def effective(docs: DataFrame) -> DataFrame:
    """(id, reason): null for effective documents; ``duplicate of x`` for later copies of effective ones.

    ``docs`` has id, path, content, graph_exclude and graph_exclude_reason.
    """
    judged = docs.select("id", F.sha2(text.canonical_content(F.col("content")), 256).alias("key"), exclusion_reason(F.col("path"), F.col("content"), F.col("graph_exclude"), F.col("graph_exclude_reason")).alias("reason"))
    # each text is judged once; excluded documents are spread by their ids
    key = F.when(F.col("reason").isNull(), F.col("key"))
    first = F.min_by("id", F.struct("id")).over(Window.partitionBy(key, F.when(key.isNull(), F.col("id"))))
    copy = F.when(first != F.col("id"), F.concat(F.lit("duplicate of "), first.cast("string")))
    return judged.select("id", F.coalesce("reason", copy).alias("reason"))


def visibility_weights(docs: DataFrame) -> DataFrame:
    """(id, display_weight, community_weight, duplicate_of) of grouped documents (id, grp, canonical, supporting).

    Supporting material is faint; of documents with one canonical key in a group, the first by id stands out.
    """
    key = ["grp", "canonical"]
    first = docs.where("not supporting").groupBy(*key).agg(F.min("id").alias("first"))
    both = docs.join(first, key, "left")
    later = F.col("id") != F.col("first")
    pick = lambda k: F.when(F.col("supporting"), SUPPORT_WEIGHTS[k]).when(later, COPY_WEIGHTS[k]).otherwise(FIRST_WEIGHTS[k])
    return both.select("id", pick(0).alias("display_weight"), pick(1).alias("community_weight"), F.when(~F.col("supporting") & later, F.col("first")).alias("duplicate_of"))


def community_labels(members: DataFrame, terms: DataFrame, most: int = 4, order: Sequence[str] = (), by_project: bool = True) -> DataFrame:
    """(community, label, keywords): the project of 15 % of a community's members (two at least), else its best term.

    ``members`` has community, node, project (null: none) and priority (an array of matched priority keywords);
    ``terms`` has node, term, w. A priority keyword of 25 % of the members (two at least) goes before the best term, and
    before the project, too, unless ``by_project``. Keywords rank as in ``order``, others after them by members. (Only
    the first keyword is ever tried, so a second bound of 55 % for it would decide nothing.)
    """
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    least = lambda share: F.greatest(F.lit(2), F.ceil(F.col("n") * share))
    place = F.array_position(F.array(*map(F.lit, order)).cast("array<string>"), F.col("term"))
    first = F.when((F.col("kind") == 2) & (place > 0), place).otherwise(len(order) + 1)
    by_score = Window.partitionBy("community").orderBy(first, F.desc("s"), "term")
    project = members.where("project is not null").groupBy("community", F.col("project").alias("term")).agg(F.count(F.lit(1)).cast("double").alias("s"))
    prior = members.select("community", F.explode("priority").alias("term")).groupBy("community", "term").agg(F.count(F.lit(1)).cast("double").alias("s"))
    words = members.select("community", "node").join(terms, "node").groupBy("community", "term").agg(F.sum("w").alias("s"))
    ranked = None
    for kind, df in ((0, project), (1, words), (2, prior)):
        part = df.withColumn("kind", F.lit(kind)).withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= most + 1)
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.join(sizes, "community")
    chosen = best.where("r = 1").groupBy("community").agg(
        F.max(F.when((F.col("kind") == 0) & (F.col("s") >= least(0.15)), F.col("term"))).alias("a"),
        F.max(F.when((F.col("kind") == 2) & (F.col("s") >= least(0.25)), F.col("term"))).alias("b"),
        F.max(F.when(F.col("kind") == 1, F.col("term"))).alias("c"),
    )
    label = F.coalesce(*("ab" if by_project else "ba"), "c", F.lit("Community"))
    words_of = ranked.groupBy("community").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("kind", "r", "term"))), lambda x: x["term"])).alias("all"))
    return sizes.select("community").join(chosen, "community", "left").join(words_of, "community", "left").select("community", label.alias("label"), F.slice(F.filter(F.coalesce("all", F.array().cast("array<string>")), lambda t: t != label), 1, most).alias("keywords"))


def distinct_labels(labels: DataFrame) -> DataFrame:
    """(community, label): repeated labels get their first keyword, or their number. One row per community kept."""
    w = Window.partitionBy("label").orderBy("community")
    n = labels.withColumn("_n", F.row_number().over(w))
    qualifier = F.try_element_at(F.filter("keywords", lambda k: k != F.col("label")), F.lit(1))
    named = n.withColumn("final", F.when(F.col("_n") == 1, F.col("label")).when(qualifier.isNotNull(), F.concat("label", F.lit(" · "), qualifier)).otherwise(F.concat("label", F.lit(" "), F.col("_n").cast("string"))))
    again = Window.partitionBy("final").orderBy("community")
    return named.withColumn("_m", F.row_number().over(again)).select("community", F.when(F.col("_m") == 1, F.col("final")).otherwise(F.concat("final", F.lit(" "), F.col("_n").cast("string"))).alias("label"))


def topic_colors(topics: DataFrame) -> DataFrame:
    """(topic, color): the topic's own colour, else its theme's hue turned by the topic's place among its siblings."""
    at = F.row_number().over(Window.partitionBy("theme").orderBy("topic")) - 1
    hsl = numeric.rgb_to_hsl(*[numeric.rgb(F.col("theme_color"))[c] for c in "rgb"])
    turned = topics.withColumn("_at", at).withColumn("_h", hsl)
    out = numeric.hsl_to_rgb((F.col("_h.h") + F.col("_at") * 11) % 360, F.col("_h.s"), F.col("_h.l"))
    return turned.withColumn("_c", out).select("topic", F.coalesce("color", F.upper(numeric.hex_color(F.col("_c.r").cast("double"), F.col("_c.g").cast("double"), F.col("_c.b").cast("double")))).alias("color"))


def display_attributes(nodes: DataFrame, focus: Sequence[str] = (), faded: float = 0.12) -> DataFrame:
    """(node, color, alpha): nodes of a focused category are full, others fade; without a focus weights show.

    ``nodes`` has node, topic, community, color and display_weight; a node's category is its topic, else its community.
    """
    category = F.coalesce("topic", F.col("community").cast("string"))
    full = F.greatest(F.lit(faded), F.coalesce("display_weight", F.lit(1.0)))
    alpha = F.when(category.isin(list(focus)), 1.0).otherwise(faded) if focus else full
    return nodes.select("node", category.alias("category"), F.coalesce("color", F.lit("#94A3B8")).alias("color"), alpha.alias("alpha"))


def federated_stats(stats: DataFrame) -> DataFrame:
    """One row over sources (source, records, documents, modified_at, truncated, status): sums, the latest time, any, the worst status."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return stats.agg(
        F.count(F.lit(1)).alias("sources"), F.sum("records").alias("records"), F.sum("documents").alias("documents"), F.max("modified_at").alias("modified_at"),
        F.bool_or("truncated").alias("truncated"), F.max_by("status", rank).alias("status"),
    )


def legend_order(themes: DataFrame, topics: DataFrame) -> DataFrame:
    """(theme, topic, size, place): topics by the place of their theme (larger first, then label), then size and label.

    ``themes`` has key, label and size, ``topics`` has key, parent, label and size; both are small.
    """
    rank = themes.select(F.col("key").alias("theme"), (F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1).alias("_rank"))
    both = topics.join(F.broadcast(rank), F.col("parent") == F.col("theme"), "left").withColumn("_rank", F.coalesce("_rank", F.lit(0)))
    place = F.row_number().over(Window.orderBy("_rank", F.desc("size"), "label"))
    return both.select(F.col("parent").alias("theme"), F.col("key").alias("topic"), "size", place.alias("place"))


def resolve_themes(asked: DataFrame, themes: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, theme): the theme that a value names, by its key, its label, either of them normalized, or the topic it names.

    ``asked`` has id and value, ``themes`` key and label, ``topics`` key, label and theme; the two are broadcast, as a
    manifest is small.
    """
    norm = lambda c: text.normalize(F.regexp_replace(c, r"[-_]+", " "))
    steps = lambda *pairs: F.inline(F.array(*[F.struct(F.lit(k).alias("step"), c.alias("name")) for k, c in pairs]))
    key, label = F.col("key"), F.col("label")
    names = themes.select(key.alias("theme"), steps((0, key), (1, label), (2, norm(key)), (2, norm(label)))).unionByName(topics.select("theme", steps((3, norm(key)), (3, norm(label)))))
    first = names.groupBy("step", "name").agg(F.min("theme").alias("theme"))
    value = F.trim(F.col("value"))
    tries = asked.select("id", steps((0, value), (1, value), (2, norm(value)), (3, norm(value))))
    best = tries.join(F.broadcast(first), ["step", "name"]).groupBy("id").agg(F.min_by("theme", "step").alias("theme"))
    return asked.select("id").join(best, "id", "left")
