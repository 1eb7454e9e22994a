"""Reading Markdown notes: scan, frontmatter, headings, tags, links and chunks.

Line-by-line state (fences, frontmatter lists, chunk budgets) runs per note in Arrow functions; notes are
independent, so the work is spread by note.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import cut_bytes

# fixed values: frontmatter keys that decide policy
POLICY_KEYS = {"archived", "corpus", "generated", "graph_exclude", "graph_exclude_reason", "record_role", "retrieval_scope", "role", "sensitivity", "status", "type"}
_SWITCHES = ("archived", "generated", "graph_exclude")
#: Paths that no pattern or escape of a file system takes otherwise.
PLAIN = re.compile(r"[\w ./-]+")
IGNORED = (".git", ".github", ".obsidian", ".trash", "node_modules", "__pycache__")


def excluded_folder(path: Column, folders: Sequence[str]) -> Column:
    """Under an excluded folder: one name matches any segment, several names match the start; case is ignored."""
    low, out = F.lower(path), F.lit(False)
    for f in folders:
        f = f.strip("/").lower()
        out = out | (low.startswith(f + "/") if "/" in f else F.exists(F.slice(F.split(low, "/"), F.lit(1), F.size(F.split(low, "/")) - 1), lambda s: s == f))
    return out


def scan(spark: SparkSession, root: str, folders: Sequence[str] = IGNORED, most_bytes: int = 8 << 20, glob: str = "*.md", only: Sequence[str] | None = None) -> DataFrame:
    """Notes under a folder: path, content, hashes of bytes and of normalized text, byte_length, mtime, valid_utf8, read_bytes.

    Reads any store that Spark reads. ``._`` files, excluded folders and files over ``most_bytes`` are left out;
    contents that are not UTF-8 are null. Where ``read_bytes`` is not ``byte_length``, a file changed while it was read.
    ``only`` names the files to read, by path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if only is None:
        raw = files.option("pathGlobFilter", glob).load(root)
    elif all(PLAIN.fullmatch(p) for p in only):
        raw = files.load([f"{root.rstrip('/')}/{p}" for p in only] or [root])
        raw = raw if only else raw.where(F.lit(False))
    else:
        raise ValueError("only plain paths can be opened by name")
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    at = F.instr("path", base) + F.lit(len(base) + 1)
    rel = F.expr("substring(path, _at)")
    rows = raw.where(F.col("length") <= most_bytes).withColumn("_at", at).withColumn("path", F.regexp_replace(rel, "%20", " ")).drop("_at")
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.where(~name.startswith("._") & ~excluded_folder(F.col("path"), folders))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return rows.select(
        "path", F.replace(text, F.lit("\0"), F.lit("")).alias("content"), F.sha2("content", 256).alias("content_sha256"), F.sha2(plain, 256).alias("norm_sha256"),
        F.col("length").alias("byte_length"), F.col("modificationTime").alias("mtime"), text.isNotNull().alias("valid_utf8"), F.octet_length("content").alias("read_bytes"),
    )


def same_state(a: DataFrame, b: DataFrame) -> bool:
    """Whether two scans saw the same files."""
    key = ["path", "byte_length", "mtime"]
    x, y = a.select(*key), b.select(*key)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def path_digest(paths: DataFrame) -> str:
    """A digest of a set of paths, independent of its order."""
    r = paths.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path")).alias("x"), F.bit_xor(F.xxhash64("path", F.lit(1))).alias("y")).first()
    return f"{r['n']}-{(r['x'] or 0) & (1 << 64) - 1:x}-{(r['y'] or 0) & (1 << 64) - 1:x}"


def plan_hash(scanned: DataFrame) -> str:
    """A digest of what a scan found, independent of its order and of the number of tasks."""
    row = scanned.select(F.sha2(F.concat_ws("\x00", "path", "content_sha256", F.col("byte_length").cast("string"), F.unix_millis("mtime").cast("string")), 256).alias("h"))
    folded = row.agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("long")).alias(f"x{k}") for k in range(4)]).first()
    return "-".join(f"{v or 0:x}" for v in folded)


def _strip_comment(value: str) -> str:
    quote = None
    for i, ch in enumerate(value):
        if ch in "\"'" and value[i - 1 : i] != "\\":
            quote = None if quote == ch else quote or ch
        elif ch == "#" and quote is None and (i == 0 or value[i - 1].isspace()):
            return value[:i]
    return value


def unquote(value: str) -> str:
    v = value.strip()
    return v[1:-1] if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'" else v


def _odd_syntax(raw: str) -> bool:
    v = _strip_comment(raw).strip()
    for q in "\"'":
        if v.startswith(q) or v.endswith(q):
            return not (len(v) > 1 and v.startswith(q) and v.endswith(q)) or (q == '"' and "\\" in v)
    return bool(re.match(r"[>|][+-]?\d*(\s|$)|[{\[]", v) or re.search(r"(^|\s)[!&*]\S?", v) and re.search(r"(^|\s)[!&*](\S|$)", v))


def parse_frontmatter(text: str, compiled: bool = False) -> tuple[dict[str, list[str]], str | None, list[str], list[str], int, bool]:
    """(fields, title, aliases, tags, first body line, parse error) of a note; what is unclear is an error, not a guess.

    The ``compiled`` form knows no null words, and trims, composes and sorts tags.
    """
    lines = text.split("\n")
    if not lines or lines[0].lstrip("﻿").strip() != "---":
        return {}, None, [], [], 0, False
    close = next((i for i, x in enumerate(lines) if i and re.fullmatch(r"---\s*", x)), None)
    if close is None:
        return {}, None, [], [], 0, True
    fields: dict[str, list[str]] = {}
    listed, seen, target, wrong = set(), set(), None, False
    for line in lines[1:close]:
        if re.fullmatch(r"\s*(#.*)?", line):
            continue
        item = re.fullmatch(r"\s*-\s+(.+?)\s*", line)
        if item and target:
            wrong |= target in POLICY_KEYS
            fields[target].append(unquote(item[1]))
            continue
        pair = re.fullmatch(r"([A-Za-z0-9_-]+):\s*(.*?)\s*", line)
        if not pair:
            wrong, target = True, None
            continue
        key, value = pair[1].lower(), pair[2]
        if key in POLICY_KEYS:
            wrong |= key in seen or _odd_syntax(value)
            seen.add(key)
        bare = _strip_comment(value).strip()
        if not value:
            fields[key], target = [], key
            listed.add(key)
        elif bare.startswith("[") and bare.endswith("]"):
            fields[key], target = [v for v in map(unquote, bare[1:-1].split(",")) if v], None
            listed.add(key)
        else:
            word = unquote(bare)
            fields[key], target = [] if not compiled and re.fullmatch(r"(?i)null|~", word) else [word], None
            listed.discard(key)
    wrong |= any(k in listed for k in POLICY_KEYS)
    wrong |= any(not re.fullmatch(r"(?i)true|false|yes|no|on|off|0|1", (fields[k] or [""])[0].strip()) for k in _SWITCHES if k in fields)
    pick = lambda *names: next((fields[n] for n in names if n in fields), [])
    split = lambda vs: [x.strip() for v in vs for x in re.split("[,，]", v) if x.strip()]
    tags = [t.lstrip("#") for t in split(pick("tags", "tag")) if t.lstrip("#")]
    if compiled:
        tags = sorted({unicodedata.normalize("NFC", t) for t in tags})
    title = next((v for v in pick("title") if v.strip()), None)
    return fields, title, list(dict.fromkeys(split(pick("aliases", "alias")))), list(dict.fromkeys(tags)), close + 1, wrong


def headings(lines: Sequence[str], start: int = 0, strict: bool = True) -> list[tuple[str, int, int]]:
    """(text, level, line from 0) outside code fences.

    The strict dialect closes a fence only by a run as long as its opening with nothing after it, and allows indented
    and closed headings; the loose one closes by any run of the same mark.
    """
    out, fence = [], None
    for n in range(start, len(lines)):
        line = lines[n]
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$" if strict else r"\s*(`{3,}|~{3,})(.*)$", line)
        if m:
            if fence is None:
                fence = m[1]
            elif m[1][0] == fence[0] and (not strict or (len(m[1]) >= len(fence) and not m[2].strip())):
                fence = None
            continue
        if fence:
            continue
        h = re.match(r" {0,3}(#{1,6})[\t ]+(.*)$" if strict else r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if h:
            text = re.sub(r"[\t ]+#+[\t ]*$", "", h[2]).strip() if strict else h[2].strip()
            if text:
                out.append((text, len(h[1]), n))
    return out


def inline_tags(lines: Sequence[str], start: int = 0) -> list[str]:
    """``#tag`` words outside fences and headings."""
    found, fence = [], None
    for line in lines[start:]:
        m = re.match(r"\s*(`{3,}|~{3,})", line)
        if m:
            fence = m[1][0] if fence is None else None if fence == m[1][0] else fence
        elif fence is None and not re.match(r"#{1,6}\s", line):
            found += re.findall(r"(?:^|(?<=\s))#([\w/-]*[^\W\d][\w/-]*)", line)
    return list(dict.fromkeys(found))


def links(content: Column) -> Column:
    """Distinct wiki targets (no alias or anchor) and Markdown links to ``.md`` files."""
    wiki = F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\]]+)\]\]"), 1), lambda x: F.trim(F.regexp_extract(x, r"^([^|#]*)", 1)))
    plain = F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)\s]+\.md)(?:#[^)]*)?\)"), 1)
    return F.array_distinct(F.filter(F.concat(wiki, plain), lambda x: x != ""))


def _size(line: str) -> int:
    return len(line.encode("utf-8", "surrogatepass"))


def _long_line(line: str, number: int, heading: str | None, most: int, overlap: int) -> Iterator[tuple]:
    at = shown = 0
    while at < len(line):
        tail = line[at:]
        window = cut_bytes(tail, most) if _size(tail) > most else tail
        if not window:
            at += max(1, min(len(tail), most * 3))
            continue
        lead = len(window) - len(window.lstrip())
        body = window.strip()
        first, last = at + lead, at + len(window.rstrip())
        grows = last > shown
        if body and grows:
            yield heading, number + 1, number + 1, first + 1, last, body
            shown = last
        if len(window) >= len(tail):
            return
        if body and not grows:
            at += max(1, shown - at)
            continue
        step = len(window)
        if overlap:
            seen = window[lead:]
            step = lead + len(cut_bytes(seen, max(1, _size(seen) - overlap)))
        at += max(1, step)


def chunk_lines(lines: Sequence[str], start: int, most: int, overlap: int) -> Iterator[tuple[str | None, int, int, int | None, int | None, str]]:
    """(heading path, first line, last line, first column, last column, content) of a note's chunks, within byte budgets.

    Sections do not mix. A chunk ends at a blank line if one lies past 45 % of the budget; the next one starts with
    whole lines of overlap. A line over the budget is cut into windows with columns.
    """
    most, start = max(200, most), max(0, min(len(lines), start))
    overlap = max(0, min(overlap, most // 3))
    marks = headings(lines, start)
    bounds: list[tuple[int, int, str | None]] = []
    if not marks or marks[0][2] > start:
        bounds.append((start, marks[0][2] if marks else len(lines), None))
    stack: list[tuple[str, int]] = []
    for k, (text, level, line) in enumerate(marks):
        while stack and stack[-1][1] >= level:
            stack.pop()
        stack.append((text, level))
        bounds.append((line, marks[k + 1][2] if k + 1 < len(marks) else len(lines), " › ".join(t for t, _ in stack)))
    for first, stop, heading in bounds:
        at = first
        while at < stop:
            if _size(lines[at]) > most:
                yield from _long_line(lines[at], at, heading, most, overlap)
                at += 1
                continue
            end, used, blank = at, 0, None
            while end < stop:
                more = _size(lines[end]) + (end > at)
                if end > at and used + more > most:
                    break
                used, end = used + more, end + 1
                if not lines[end - 1].strip() and used >= int(most * 0.45):
                    blank = end
                if used >= most:
                    break
            if blank and end < stop:
                end = blank
            content = "\n".join(lines[at:end]).strip()
            if content:
                yield heading, at + 1, end, None, None, content
            nxt = end
            if end < stop and overlap:
                kept = 0
                while nxt > at + 1 and kept + _size(lines[nxt - 1]) + 1 <= overlap:
                    kept += _size(lines[nxt - 1]) + 1
                    nxt -= 1
            at = nxt


def parse_notes(notes: DataFrame, compiled: bool = False) -> DataFrame:
    """Adds fields, title, aliases, tags, headings, body_start, body and parse_error to (path, content, ...)."""
    schema = "fields map<string,array<string>>, title string, aliases array<string>, tags array<string>, headings array<struct<text:string,level:int,line:int>>, body_start int, body string, parse_error boolean"

    @F.pandas_udf(schema)
    def f(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(path, content):
            c = c or ""
            fields, title, aliases, tags, start, wrong = parse_frontmatter(c, compiled)
            lines = c.split("\n")
            found = headings(lines, start, strict=False)
            first = next((h[0] for h in found if compiled or h[1] == 1), None)
            name = re.sub(r"(?i)\.md$", "", (p or "").split("/")[-1])
            if wrong:
                fields = fields | {"__policy_parse_error": ["true"]}
            own = list(dict.fromkeys([*tags, *inline_tags(lines, start)]))
            rows.append((fields, title or first or name, aliases, sorted(own) if compiled else own, [{"text": t, "level": v, "line": n} for t, v, n in found], start, "\n".join(lines[start:]), wrong))
        return pd.DataFrame(rows, columns=["fields", "title", "aliases", "tags", "headings", "body_start", "body", "parse_error"])

    return notes.withColumn("_p", f("path", "content")).select(*notes.columns, "_p.*")


def chunks(df: DataFrame, id_col: str, content_col: str, most: int = 700, overlap: int = 80, start_col: str | None = None) -> DataFrame:
    """(id, chunk, heading, start_line, end_line, start_col, end_col, content) of every text, in order of ``chunk`` from 0."""
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, chunk int, heading string, start_line int, end_line int, start_col int, end_col int, content string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, start in zip(pdf["id"], pdf["content"], pdf["start"]):
                for k, c in enumerate(chunk_lines((text or "").split("\n"), int(start), most, overlap)):
                    rows.append((i, k, *c))
            out = pd.DataFrame(rows, columns=["id", "chunk", "heading", "start_line", "end_line", "start_col", "end_col", "content"])
            yield out.astype({"start_col": "Int32", "end_col": "Int32"})

    start = F.col(start_col) if start_col else F.lit(0)
    return df.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"), start.alias("start")).mapInPandas(run, schema)


def read_section(text: str, heading: str | None = None, most: int = 50_000) -> str:
    """A note, or the section under a heading up to the next one of its level or above."""
    lines = text.split("\n")
    if heading is not None:
        found = headings(lines)
        k = next((i for i, h in enumerate(found) if h[0].casefold() == heading.casefold()), None)
        if k is None:
            return ""
        stop = next((h[2] for h in found[k + 1 :] if h[1] <= found[k][1]), len(lines))
        lines = lines[found[k][2] : stop]
    return "\n".join(lines)[:most]


def active_heading(marks: DataFrame, spots: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """As-of join: the last heading of each level that starts at or before a spot, unless a higher one came after it.

    ``marks`` is (id, line, level, text) and ``spots`` (id, spot); returns (id, spot, path). Marks and spots are one
    ordered stream, in which each row carries the last heading of each level. A note is cut into buckets of ``bucket``
    lines, which are separate; what a bucket starts with is carried from the last headings of those before it. A row
    costs the same however many headings there are. Spots without an id, or before all headings, have a null path.
    """
    kind = dict(marks.dtypes)["text"]
    at_bucket = F.floor(F.col("at") / bucket).alias("bucket")
    mark = marks.select("id", F.col("line").cast("long").alias("at"), F.lit(0).alias("after"), F.col("level").cast("int").alias("level"), F.col("text"))
    spot = spots.select("id", F.col("spot").cast("long").alias("at"), F.lit(1).alias("after"), F.lit(None).cast("int").alias("level"), F.lit(None).cast(kind).alias("text"))
    rows = mark.unionByName(spot).select("*", at_bucket)
    here = F.struct("level", F.col("at").alias("line"), "text")
    levels = range(1, 7)
    ends = mark.select("id", at_bucket, "level", "at", here.alias("h")).groupBy("id", "bucket").agg(*[F.max_by(F.when(F.col("level") == n, F.col("h")), F.when(F.col("level") == n, F.col("at"))).alias(f"e{n}") for n in levels])
    known = rows.where("after = 1").select("id", "bucket").distinct().join(ends, ["id", "bucket"], "full")
    earlier = Window.partitionBy("id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = known.where("id is not null").select(F.col("id").alias("_id"), F.col("bucket").alias("_bucket"), *[F.last(f"e{n}", True).over(earlier).alias(f"c{n}") for n in levels])
    seen = Window.partitionBy("id", "bucket").orderBy("at", "after").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("id", "bucket", "at", "after", *[F.last(F.when(F.col("level") == n, here), True).over(seen).alias(f"s{n}") for n in levels]).where("after = 1")
    found = found.join(carried, (F.col("id") == F.col("_id")) & (F.col("bucket") == F.col("_bucket")), "left")
    there = F.filter(F.array(*[F.coalesce(f"s{n}", f"c{n}") for n in levels]), lambda x: x.isNotNull())
    open_ones = F.filter("s", lambda x: ~F.exists("s", lambda y: (y["level"] < x["level"]) & (y["line"] > x["line"])))
    found = found.select("id", "at", there.alias("s")).select("id", "at", open_ones.alias("s"))
    path = F.when(F.col("id").isNotNull() & (F.size("s") > 0), F.array_join(F.transform("s", lambda x: x["text"]), " › "))
    return found.select("id", F.col("at").alias("spot"), path.alias("path"))


def graph_documents(notes: DataFrame) -> DataFrame:
    """Documents for the graph analysis from notes (path, content): parsed, with what their frontmatter says of the graph."""
    first = lambda key: F.get(F.element_at("fields", key), F.lit(0))
    parsed = parse_notes(notes)
    return parsed.select(
        F.col("path").alias("id"), "path", "title", "aliases", "tags", F.transform("headings", lambda h: h["text"]).alias("headings"), "content",
        F.coalesce(F.lower(F.trim(first("graph_exclude"))).isin("true", "yes", "on", "1"), F.lit(False)).alias("graph_exclude"), first("graph_exclude_reason").alias("graph_exclude_reason"),
        first("graph_primary_topic").alias("primary"), first("graph_primary_theme").alias("theme"), F.element_at("fields", "graph_secondary_topics").alias("others"),
    )
