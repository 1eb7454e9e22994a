"""The whole graph analysis in one call: from documents and links to communities, hubs, colours, labels and legend."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric, policy, text
from tessera.operators import graph, topics
from tessera.sources import taxonomy


@dataclass(frozen=True)
class Analysis:
    """The tables of an analysis. What several of them share is checkpointed, so each has a short plan of its own.

    documents (id, reason), edges (src, dst, w), assignments (id, key, label, parent, ...), communities (node,
    community), hubs (community, hub), affinity (node, community, a), labels (community, label), colors (node, color),
    legend (theme, topic, size, percentage), recommended (key, size, percentage, rank), clusters (community, size, ...).
    """

    documents: DataFrame
    edges: DataFrame
    assignments: DataFrame
    communities: DataFrame
    hubs: DataFrame
    affinity: DataFrame
    labels: DataFrame
    colors: DataFrame
    legend: DataFrame
    recommended: DataFrame
    clusters: DataFrame


def analyse(docs: DataFrame, links: DataFrame, topic_rows: DataFrame, most: int = 12, least: int = 2, priority: Sequence[str] = (), by_project: bool = True) -> Analysis:
    """Analyse documents (id, path, title, aliases, tags, headings, content, graph_exclude, graph_exclude_reason) and their links (src, dst).

    Excluded documents take no part. With ``by_project`` communities are consolidated from the assigned groups, else
    found by Louvain and consolidated after. ``topic_rows`` is a manifest's table.
    """
    graph.own_checkpoint_dir(docs.sparkSession)
    judged = topics.effective(docs).checkpoint()
    live = docs.join(judged.where("reason is null").select("id"), "id")
    assigned = taxonomy.assign(live, taxonomy.profile(live, topic_rows).checkpoint(), graph.projects(live)).checkpoint()
    searchable = text.normalize(F.concat_ws(" ", "title", F.array_join("aliases", " "), F.array_join("tags", " "), F.array_join("headings", " "), "content"))
    marked = live.select("id", searchable.alias("searchable")).join(assigned, "id")
    markers = graph.marker_features(marked.select("id", "contexts", "topics", "parent", "searchable"), priority)
    feats = graph.features(live, markers=markers).checkpoint()
    navigation = live.where(policy.is_navigation(F.col("path"), F.col("title"), F.col("tags"), F.lit(""), F.col("content"))).select(F.col("id").alias("node"))
    groups = assigned.where(~F.col("key").startswith("@root:")).select(F.col("key").alias("grp"), F.col("id").alias("node"))
    linked = graph.merge_edges(links.select("src", "dst", F.lit(1.0).alias("w")))
    inside = graph.restrict(linked, live.select(F.col("id").alias("node")))
    edges = graph.hybrid_edges(inside, navigation, groups, feats).checkpoint()

    nodes = assigned.select(F.col("id").alias("node"), F.col("key").alias("project"), "weight")
    if by_project:
        communities = graph.consolidate_projects(edges, nodes, most, least)
    else:
        communities = graph.consolidate(edges, graph.communities(edges), most, least, nodes.select("node", "project"))
    shown = live.select(F.col("id").alias("node"), "title").join(navigation.withColumn("navigation", F.lit(True)), "node", "left").join(nodes, "node")
    facts = shown.select("node", "title", F.coalesce("navigation", F.lit(False)).alias("navigation"), F.col("weight").alias("display_weight"))
    communities = communities.checkpoint()
    hubs = graph.hubs(communities, graph.representative_scores(edges, facts)).checkpoint()
    affinity = graph.propagate(edges, communities, hubs)

    hue = numeric.hsl_to_rgb(numeric.golden_hue(F.col("community"), 210.0), F.lit(0.76), F.lit(0.61))
    palette = hubs.select("community", hue.alias("c")).select("community", *[F.col(f"c.{x}").alias(x) for x in "rgb"])
    own = topics.topic_colors(topic_rows).select(F.concat(F.lit("@knowledge:"), "topic").alias("key"), F.col("color"))
    colored = assigned.join(F.broadcast(own), "key", "left").select(F.col("id").alias("node"), "color", F.col("weight").alias("display_weight"))
    colored = colored.join(hubs.select(F.col("hub").alias("node"), F.col("community").alias("hub")), "node", "left")
    members = communities.where("community >= 0").join(assigned.select(F.col("id").alias("node"), F.when(~F.col("key").startswith("@root:"), F.col("label")).alias("project")), "node")
    held = marked.select(F.col("id").alias("node"), F.filter(F.array(*[F.lit(p.lower()) for p in priority]).cast("array<string>"), lambda p: F.contains(F.col("searchable"), p)).alias("priority"))
    members = members.join(held, "node")
    terms = feats.where(~F.col("term").startswith("@")).select(F.col("id").alias("node"), "term", "w")
    legend = graph.legend(assigned.select(F.coalesce("parent", F.lit("@theme:unclassified")).alias("theme"), F.col("label").alias("topic")))
    themes = legend.where((F.col("topic").isNull()) & (F.col("theme") != "@theme:unclassified")).select(F.col("theme").alias("key"), "size", "percentage")
    return Analysis(
        judged, edges, assigned, communities, hubs, affinity, topics.distinct_labels(topics.community_labels(members, terms, order=[p.lower() for p in priority], by_project=by_project)),
        graph.colorize(edges, affinity, palette, colored), legend, graph.natural_break(themes), graph.cluster_summary(communities, edges, facts.select("node", "display_weight")),
    )
