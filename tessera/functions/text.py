"""Text functions as columns; Arrow functions only for Unicode normalization and byte-exact cuts.

Lengths and places count code points. NFKC is applied where ``compat`` asks for it, to values that are not ASCII.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that the lexical tokenizer drops, and words that queries drop
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is",
    "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "where",
    "which", "who", "why", "with",
]
QUERY_FILLERS = ["about", "document", "documents", "find", "locate", "lookup", "note", "notes", "please", "search", "show", "tell"]
SHELL_WORDS = ["about", "find", "locate", "lookup", "please", "show", "tell"]

_CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


#: Texts of an Arrow batch that are Python values at a time; a batch has as many rows as the session says, however long.
AT_ONCE = 64


def in_slices(rows: int) -> Iterator[slice]:
    return (slice(at, at + AT_ONCE) for at in range(0, rows, AT_ONCE))


def _normal(form: str):
    @F.arrow_udf("string")
    def f(s: pa.Array) -> pa.Array:
        parts = [pa.array([None if x is None else unicodedata.normalize(form, x) for x in s[at].to_pylist()], pa.string()) for at in in_slices(len(s))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return f


def nfkc(c: Column) -> Column:
    """NFKC; ASCII values, which it leaves alone, stay in the JVM."""
    return F.coalesce(_normal("NFKC")(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def nfc(c: Column) -> Column:
    return _normal("NFC")(c)


def normalize(c: Column, compat: bool = False) -> Column:
    """Lower case, runs of white space as one space, trimmed; ``compat`` applies NFKC first."""
    c = nfkc(c) if compat else c
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ngrams(a: Column, n: int, glue: str = "") -> Column:
    """All runs of ``n`` neighbouring elements of an array, joined."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1)))
        return F.coalesce(F.transform(at, lambda i: F.array_join(F.slice(w, i, n), glue)), F.array().cast("array<string>"))

    return let(a, runs)


def tokens(c: Column, compat: bool = False, cjk: bool = True) -> Column:
    """Words of letters and digits; a word with a CJK character also gives its characters and character pairs."""
    words = F.regexp_extract_all(normalize(c, compat), F.lit(r"([\p{L}\p{N}]+)"), 1)
    if not cjk:
        return words
    chars = lambda w: F.filter(F.split(w, ""), lambda x: x != "")
    spread = lambda w: F.when(w.rlike(_CJK), F.concat(F.array(w), chars(w), ngrams(chars(w), 2))).otherwise(F.array(w))
    return F.flatten(F.transform(words, spread))


def lexical_tokens(c: Column, compat: bool = False) -> Column:
    """ASCII words without stop words (longer than a letter, or digits), then CJK pairs; ``-._/\\`` separate words."""
    base = F.regexp_replace(F.lower(nfkc(c) if compat else c), r"[-._/\\]+", " ")
    words = F.regexp_extract_all(base, F.lit(r"([a-z0-9][a-z0-9+]*(?:'[a-z0-9]+)?)"), 1)
    stop = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(words, lambda w: ((F.length(w) > 1) | w.rlike("^[0-9]+$")) & ~F.array_contains(stop, w))
    runs = F.regexp_extract_all(base, F.lit("([㐀-鿿]+)"), 1)
    chars = lambda r: F.filter(F.split(r, ""), lambda x: x != "")
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(ngrams(chars(r), 2))))
    return F.concat(kept, pairs)


def plain_tokens(text: str) -> list[str]:
    """Lexical tokens of a single text."""
    import re

    base = re.sub(r"[-._/\\]+", " ", unicodedata.normalize("NFKC", text).lower())
    out = [w for w in re.findall(r"[a-z0-9][a-z0-9+]*(?:'[a-z0-9]+)?", base) if (len(w) > 1 or w.isdigit()) and w not in STOP_WORDS]
    for run in re.findall("[㐀-鿿]+", base):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def query_tokens(text: str) -> list[str]:
    """Lexical tokens of a query without courtesy and filler words, unless nothing would be left."""
    out = plain_tokens(text)
    polite = [w for w in out if w != "please"]
    plain = [w for w in polite if w not in QUERY_FILLERS]
    return plain or polite or out


def graph_tokens(c: Column, generic: list[str] | None = None, compat: bool = False) -> Column:
    """Distinct Latin terms of three letters or more, and Han runs of at most ten characters with their 2- to 4-grams."""
    low = F.lower(nfkc(c) if compat else c)
    latin = F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9+#.]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit(r"(\p{IsHan}{2,})"), 1)
    whole = F.filter(runs, lambda r: F.length(r) <= 10)
    head = lambda r, n: F.slice(ngrams(F.filter(F.split(r, ""), lambda x: x != ""), n), 1, 18)
    grams = F.flatten(F.transform(runs, lambda r: F.concat(head(r, 2), head(r, 3), head(r, 4))))
    out = F.array_distinct(F.concat(latin, whole, grams))
    return F.array_except(out, F.array(*map(F.lit, generic))) if generic else out


def shingles(words: Column, width: int = 3, glue: str = "\x01") -> Column:
    """Distinct runs of ``width`` words; at most ``width`` words are one run."""
    def runs(w: Column) -> Column:
        few = F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(w, glue)))
        return F.when(F.size(w) <= width, few).otherwise(F.array_distinct(ngrams(w, width, glue)))

    return let(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays without repeats; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def contains_phrase(value: Column, query: str) -> Column:
    """Whether a normalized query stands in the value, at ASCII word bounds if it has ASCII letters or digits."""
    import re

    q = " ".join(unicodedata.normalize("NFKC", query).lower().split())
    v = normalize(value)
    if not re.search("[a-z0-9]", q):
        return F.contains(v, F.lit(q))
    return v.rlike(r"(?:^|[^a-z0-9])\Q" + q.replace(r"\E", r"\E\\E\Q") + r"\E(?=$|[^a-z0-9])")


def occurrences(text: Column, term: Column, most: int = 4) -> Column:
    """How often a term occurs, at word bounds if it is ASCII; at most ``most``, 0 in a null text."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), term, F.lit(r"\E(?![a-z0-9])"))
    bare = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    pattern = F.when(term.rlike("^[\\x00-\\x7f]+$"), quoted).otherwise(bare)
    return F.least(F.coalesce(F.regexp_count(F.lower(text), pattern), F.lit(0)), F.lit(most))


def term_weight(text: Column, term: Column) -> Column:
    """``d * (1 + 0.35 * min(3, n - 1))`` where the term occurs ``n`` times; ``d`` is 1.35 for phrases and long terms."""
    n = occurrences(text, term)
    d = F.when(F.contains(term, F.lit(" ")) | (F.length(term) >= 4), 1.35).otherwise(1.0)
    return F.when(n > 0, d * (1 + 0.35 * F.least(n - 1, F.lit(3)))).otherwise(0.0)


def sentences(c: Column) -> Column:
    """Trimmed sentences, without empty ones."""
    parts = F.regexp_extract_all(c, F.lit("([^.!?。！？\\n]+[.!?。！？]?)"), 1)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def humanize(c: Column) -> Column:
    """A file or tag name as a label: no extension, separators as spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\.md$", ""), r"[-_\s]+", " "))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def qualified_name(path: Column) -> Column:
    """``parent / file`` of a path, or the file alone."""
    parts = F.split(F.regexp_replace(path, r"(?i)\.md$", ""), "/")
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -2), F.lit(" / "), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))


def strip_frontmatter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")


def canonical_content(c: Column) -> Column:
    """Content as compared for exact copies: no frontmatter, LF line ends, no trailing blanks, trimmed."""
    lf = F.regexp_replace(strip_frontmatter(c), r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def keywords(c: Column) -> Column:
    """Distinct normalized entries of a list separated by commas, semicolons or line ends."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,，;；\n]+"), lambda x: normalize(x)), lambda x: x != ""))


def open_uri(scheme: str, vault: Column, path: Column) -> Column:
    """A link that opens a file in a host application; spaces as ``%20``."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{scheme}://open?vault="), enc(vault), F.lit("&file="), enc(path))


def byte_tokens(c: Column) -> Column:
    """The token estimate: UTF-8 bytes."""
    return F.octet_length(F.encode(c, "utf-8"))


def cut_bytes(text: str, most: int) -> str:
    """The longest start of a text within ``most`` bytes, on a character bound, without blanks at its end."""
    return text.encode()[: max(0, most)].decode("utf-8", "ignore").rstrip()


def truncate_bytes(c: Column, most: int) -> Column:
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: cut_bytes(x, most), na_action="ignore")

    return F.when(byte_tokens(c) <= most, c).otherwise(f(c))
