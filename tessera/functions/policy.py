"""Retrieval policy: ordered rules that decide a note's corpus and scope, as one column.

Rules are rows of a list, tried in order. Frontmatter is a map of string lists; what a note says of itself may narrow
its scope, never widen it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let, nfkc

# fixed values: names that the rules know
CONTROL_SEGMENTS = [".agents", ".codex", ".git", ".github", ".obsidian", ".trash", "__pycache__", "build", "dist", "node_modules"]
GENERATED_TYPES = ["generated", "knowledge-index", "knowledge-point-index", "rag-index", "rag-document-map"]
HISTORY_ROLES = ["archive-artifact", "conversation-archive", "source-attachment-reading-copy", "historical-output", "audit-derived"]
RESTRICTED = ["confidential", "pii", "personal", "private", "restricted", "sensitive", "secret", "credential", "credentials", "highly-sensitive"]
OPEN = ["internal", "low", "none", "normal", "open", "public", "sanitized", "standard"]
NAVIGATION_TYPES = ["index", "dashboard", "navigation", "knowledge-navigation", "context-index"]
SCOPE_WORDS = {
    "default": ["default", "core", "canonical"],
    "project": ["project", "active"],
    "reference": ["reference", "source"],
    "history": ["history", "historical", "archive"],
    "never": ["never", "none", "excluded"],
}
CORPUS_WORDS = {
    "core": ["core", "canonical"],
    "project": ["project", "active"],
    "reference": ["reference", "source"],
    "history": ["history", "historical", "archive"],
    "control": ["control", "system", "instruction"],
    "generated": ["generated", "derived-index"],
}
LEGACY_PROMPTS = ["50-ai/prompts/legacy/"]
HISTORY_FOLDERS = ["40_archive/", "40-archive/", "90-reports/", "01-daily/", "05-daily/", "50-ai/outputs/"]
SHARED_FOLDERS = ["30-shared-knowledge/"]
CONTEXT_FOLDERS = ["50-ai/codex-context/"]
PROJECT_FOLDERS = ["10-work/", "20-competition/", "00-inbox/", "projects/"]
REFERENCE_FOLDERS = ["40-resources/", "60-file-index/", "research/", "sources/"]
PRIORITY = {"default": 0, "project": 1, "reference": 2, "history": 3, "never": 4}
SUPPORT_FOLDERS = [
    ".github", "issues?-archive", "tests?", "fixtures?", "examples?", "references?", "commands?", "library", "skill-output-samples", "node_modules", "docs?",
    "site", "scripts?", "hooks?", "templates?", "research", "catalog", "knowledge", "_workflows", "_agent-context", "comparison",
]
SUPPORT_NAMES = ["history", "changelog", "contributing", "code_of_conduct", "privacy", "todos?"]
_GRAPH_REASON = r"(?i)generated|system|duplicate|navigation|empty|index|自动生成|生成|系统|重复|副本|导航|空|索引"
_NAV_NAME = r"(?i)readme|index|dashboard|homepage|overview|contents|目录|索引|导航|首页|总览|概览"
_KEPT = r"[^0-9A-Za-z㐀-鿿]+"
_LETTER = r"[0-9A-Za-z㐀-鿿]"


def scalar(front: Column, key: str) -> Column:
    """The first value of a key, trimmed and in lower case; '' if there is none."""
    return F.coalesce(F.lower(F.trim(F.get(F.element_at(front, key), F.lit(0)))), F.lit(""))


def truthy(front: Column, key: str) -> Column:
    return scalar(front, key).isin("true", "yes", "on", "1")


def _lookup(words: dict[str, list[str]], value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, known in reversed(words.items()):
        out = F.when(value.isin(known), name).otherwise(out)
    return out


def field(front: Column, key: str, words: dict[str, list[str]], dashes: bool) -> tuple[Column, Column]:
    """A policy field's meaning, and whether it is there but means nothing."""
    raw = F.element_at(front, key)
    value = F.lower(F.trim(F.get(raw, F.lit(0))))
    found = F.when(F.size(raw) == 1, _lookup(words, F.replace(value, F.lit("_"), F.lit("-")) if dashes else value))
    return found, raw.isNotNull() & found.isNull()


def priority(scope: Column) -> Column:
    out = F.lit(4)
    for name, p in PRIORITY.items():
        out = F.when(scope == name, p).otherwise(out)
    return out


def has_body(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)<!--.*?-->", " ").rlike(_LETTER)


def link_count(body: Column) -> Column:
    return F.regexp_count(body, F.lit(r"\[\[[^\]]+\]\]")) + F.regexp_count(body, F.lit(r"!?\[[^\]]*\]\([^)]+\)")) + F.regexp_count(body, F.lit(r"(?i)https?://\S+"))


def prose_length(body: Column) -> Column:
    """Letters and digits left without comments, code, headings, links, tables and list marks."""
    out = body
    for pattern in (r"(?s)<!--.*?-->", r"(?s)```.*?```", r"(?m)^#{1,6}\s+.*$", r"!?\[\[[^\]]+\]\]", r"!?\[[^\]]*\]\([^)]+\)", r"(?i)https?://\S+", r"(?m)^\s*\|.*\|\s*$", r"(?m)^\s*[-*+]\s*"):
        out = F.regexp_replace(out, pattern, " ")
    return F.length(F.regexp_replace(out, _KEPT, ""))


def is_link_list(body: Column) -> Column:
    """Links with hardly any prose; the prose of a text without links is not measured."""
    whole = F.greatest(F.length(F.regexp_replace(body, _KEPT, "")), F.lit(1))
    few = lambda n: let(prose_length(body), lambda prose: (prose < 16) | ((n >= 3) & ((prose < 180) | (prose / whole < 0.16))))
    return let(link_count(body), lambda n: F.when(n > 0, few(n)).otherwise(n > 0))


def is_navigation(path: Column, title: Column, tags: Column, kind: Column, body: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")
    names = F.concat_ws(" ", name, title, F.array_join(tags, " "))
    return kind.isin(NAVIGATION_TYPES) | (names.rlike(_NAV_NAME) & is_link_list(body))


def classify(path: Column, front: Column, body: Column, title: Column, tags: Column) -> Column:
    """STRUCT<corpus, scope, reason> by the first rule that holds, then narrowed by frontmatter.

    Each value that several rules use is bound once, so the expression grows with the rules and not with their product.
    """
    low = F.lower(nfkc(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", ""), "/{2,}", "/")))
    scope, bad_scope = field(front, "retrieval_scope", SCOPE_WORDS, True)
    corpus, bad_corpus = field(front, "corpus", CORPUS_WORDS, False)
    facts = F.struct(
        low.alias("low"), *[scalar(front, k).alias(k) for k in ("type", "status", "sensitivity", "record_role", "role", "graph_exclude_reason")],
        *[truthy(front, k).alias(k) for k in ("graph_exclude", "archived", "generated", "__policy_parse_error")],
        scope.alias("scope"), bad_scope.alias("bad_scope"), corpus.alias("corpus"), bad_corpus.alias("bad_corpus"),
    )
    return let(facts, lambda x: _decide(x, body, title, tags))


def _decide(x: Column, body: Column, title: Column, tags: Column) -> Column:
    low, kind, status, secrecy = x["low"], x["type"], x["status"], x["sensitivity"]
    parts = F.split(low, "/")
    name, head = F.element_at(parts, -1), F.element_at(parts, 1)
    role = F.when(x["record_role"] != "", x["record_role"]).otherwise(x["role"])
    scope, bad_scope, corpus, bad_corpus = x["scope"], x["bad_scope"], x["corpus"], x["bad_corpus"]
    hidden, graph_reason = x["graph_exclude"], x["graph_exclude_reason"]
    under = lambda *p: low.rlike("^(?:" + "|".join(x.replace("-", r"\-") for x in p) + ")")
    decision = lambda *parts: [p if isinstance(p, Column) else F.lit(p) for p in parts]
    never = lambda c, r: decision(c, "never", r)
    sensitive = secrecy.isin(RESTRICTED) | secrecy.rlike(r"^restricted(?:[-_/]|$)") | secrecy.rlike(r"(?:^|[-_/])(confidential|credential|personal|pii|private|secret|sensitive)(?:[-_/]|$)")
    invalid = F.concat(F.lit("invalid policy field: "), F.concat_ws(", ", F.when(bad_scope, "retrieval_scope"), F.when(bad_corpus, "corpus")))
    deny = [
        (name.startswith("._"), never("control", "AppleDouble metadata")),
        (F.arrays_overlap(parts, F.array(*map(F.lit, CONTROL_SEGMENTS))), never("control", "control or system path")),
        (name.isin("agents.md", "agent.md"), never("control", "agent instruction document")),
        (x["__policy_parse_error"], never("control", "invalid frontmatter policy syntax")),
        (sensitive, never("control", F.concat(F.lit("restricted sensitivity: "), secrecy))),
        ((secrecy != "") & ~secrecy.isin(OPEN), never("control", "unrecognized sensitivity policy")),
        ((head == "80-knowledge-index") | F.array_contains(parts, "_generated"), never("generated", "generated knowledge index")),
        (head == "99-attachments", never("generated", "attachment storage path")),
        (bad_scope | bad_corpus, never("control", invalid)),
        (kind.isin(GENERATED_TYPES) | x["generated"], never("generated", F.concat(F.lit("generated type: "), kind))),
        (corpus.isin("control", "generated"), never(corpus, F.concat(F.lit("frontmatter corpus: "), corpus))),
        (scope == "never", never("control", "frontmatter retrieval_scope")),
        (~has_body(body), never("generated", "empty body")),
        (hidden & graph_reason.rlike(_GRAPH_REASON), never("generated", F.concat(F.lit("graph exclusion: "), graph_reason))),
        (is_navigation(low, title, tags, kind, body), never("generated", "navigation or index document")),
    ]
    history = lambda r: decision("history", "history", r)
    base = [
        (under(*LEGACY_PROMPTS), history("legacy instruction reference")),
        (x["archived"] | status.rlike("^(?:archived|historical|superseded)"), history("historical status")),
        (role.isin(HISTORY_ROLES), history(F.concat(F.lit("historical role: "), role))),
        (F.exists(tags, lambda t: t.rlike(r"(?i)^(?:archive|status/imported-archive)(?:/|$)")), history("archive tag")),
        (hidden, history("frontmatter graph_exclude")),
        (low.contains("/ai历史记录/") | low.contains("/ai-history/"), history("AI conversation history path")),
        (under(*HISTORY_FOLDERS), history("historical path")),
        (under(*SHARED_FOLDERS) & (kind == "knowledge-card") & ~status.rlike("filed|draft|pending|superseded"), decision("core", "default", "active shared knowledge card")),
        (under(*SHARED_FOLDERS), decision("reference", "reference", "shared guide or source note")),
        (under(*CONTEXT_FOLDERS), decision("core", "default", "explicit model context")),
        (under(*PROJECT_FOLDERS), decision("project", "project", "active project path")),
        (under(*REFERENCE_FOLDERS), decision("reference", "reference", "reference or source path")),
    ]

    def cascade(rules: list[tuple[Column, list[Column]]], otherwise: Column) -> Column:
        out = otherwise
        for test, result in reversed(rules):
            fixed = F.struct(*[x.alias(n) for x, n in zip(result, ("corpus", "scope", "reason"))])
            out = F.when(F.coalesce(test, F.lit(False)), fixed).otherwise(out)
        return out

    plain = F.struct(F.lit("reference").alias("corpus"), F.lit("reference").alias("scope"), F.lit("unclassified path defaults to reference").alias("reason"))
    corpus_scope = F.when(corpus == "core", "default").when(corpus.isin("project", "reference", "history"), corpus)
    stricter = F.when(corpus_scope.isNull() | (priority(scope) >= priority(corpus_scope)), scope).otherwise(corpus_scope)
    wish = F.struct(F.when(scope.isNull(), corpus_scope).otherwise(stricter).alias("scope"), corpus_scope.alias("by_corpus"))

    def narrow(both: Column) -> Column:
        start, asked = both["start"], both["wish"]["scope"]
        asked_corpus = F.when(both["wish"]["by_corpus"] == asked, corpus).when(asked == "default", "core").otherwise(asked)
        kept = F.struct(start["corpus"].alias("corpus"), start["scope"].alias("scope"), F.concat(start["reason"], F.lit("; ignored untrusted frontmatter promotion")).alias("reason"))
        taken = F.struct(asked_corpus.alias("corpus"), asked.alias("scope"), F.lit("restrictive frontmatter policy").alias("reason"))
        return F.when(asked.isNull(), start).when(priority(asked) < priority(start["scope"]), kept).otherwise(taken)

    return cascade(deny, let(F.struct(cascade(base, plain).alias("start"), wish.alias("wish")), narrow))


def source_decision(path_scope: Column, source_scope: Column) -> Column:
    """The scope of a note in a source with a scope of its own; a conflict hides it."""
    return F.when(source_scope.isNull() | (path_scope == "never") | (path_scope == source_scope), path_scope).otherwise("never")


def reason_bucket(reason: Column) -> Column:
    """Exclusion reasons without their variable parts."""
    out = reason
    for head in ("restricted sensitivity", "invalid policy field", "generated type", "frontmatter corpus", "graph exclusion", "historical role"):
        out = F.when(reason.startswith(head), head).otherwise(out)
    return out


def is_supporting(path: Column, navigation: Column) -> Column:
    """Whether a document only supports others: by a folder or file name of its path, or as navigation."""
    low = F.lower(nfkc(path))
    folder = "(?:^|/)(?:" + "|".join(SUPPORT_FOLDERS).replace(".", r"\.") + ")(?:/|$)"
    name = "(?:^|/)(?:" + "|".join(SUPPORT_NAMES) + r")\.md$"
    return low.rlike(folder) | low.rlike(name) | F.coalesce(navigation, F.lit(False))
