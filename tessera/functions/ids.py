"""Hashes and stable identities as columns."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_SEED, FNV_PRIME, _MASK = 2166136261, 16777619, 4294967295


def fnv1a(c: Column, seed: int = FNV_SEED) -> Column:
    """32-bit FNV-1a over the characters of a text."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(_MASK))
    return F.aggregate(chars, F.lit(seed).cast("long"), step)


def short_hash(c: Column) -> Column:
    """FNV-1a over the first 12,000 characters, in base 36."""
    return F.lower(F.conv(fnv1a(F.substring(c, 1, 12000)).cast("string"), 10, 36))


def feature_slot(token: Column, dims: int) -> tuple[Column, Column]:
    """Dimension and sign of a token in a hashed feature vector."""
    sign = F.when(fnv1a(token, 2654435769) % 2 == 0, 1.0).otherwise(-1.0)
    return (fnv1a(token) % dims).cast("int"), sign


def _framed(c: Column) -> Column:
    raw = F.encode(c, "utf-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)


def stable_id(kind: str, *parts: Column, prefix: str, namespace: str = "tessera", version: str = "1") -> Column:
    """SHA-256 over a name and length-framed parts, in URL-safe base 64, with a kind prefix."""
    head = F.lit(f"{namespace}\x00{version}\x00{kind}".encode())
    digest = F.unhex(F.sha2(F.concat(head, *map(_framed, parts)), 256))
    return F.concat(F.lit(prefix), F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("=")))


def source_id(name: Column) -> Column:
    return stable_id("source", name, prefix="src_")


def document_id(source: Column, path: Column) -> Column:
    return stable_id("document", source, path, prefix="doc_")


def version_id(document: Column, content: Column) -> Column:
    return stable_id("version", document, F.sha2(content, 256), prefix="ver_")


def span_id(version: Column, start: Column, end: Column) -> Column:
    return stable_id("span", version, start.cast("string"), end.cast("string"), prefix="spn_")


def chunk_id(span: Column, content: Column) -> Column:
    return stable_id("chunk", span, content, prefix="chk_")


def body_hash(normalized: Column, most: int | None = None) -> Column:
    """SHA-256 of a normalized body, or of its first ``most`` characters."""
    return F.sha2(F.substring(normalized, 1, most) if most else normalized, 256)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def sign(value: object, key: bytes) -> str:
    return hmac.new(key, canonical_json(value).encode(), "sha256").hexdigest()


def signed_by(value: object, key: bytes, signature: str) -> bool:
    return hmac.compare_digest(sign(value, key), signature)


def _segments(c: Column, rooted: bool) -> Column:
    """Path segments without empty ones and ``.``; ``..`` takes the one before it away (or stays at a start that is no root)."""
    parts = F.filter(F.split(c, "/"), lambda s: (s != "") & (s != "."))

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = (s == "..") & last.isNotNull() & (last != "..")
        shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        outside = (s == "..") & F.lit(rooted)
        return F.when(back, shorter).when(outside, kept).otherwise(F.concat(kept, F.array(s)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def source_identity(c: Column) -> Column:
    """One name for a source whatever the notation: ``win32:``, ``win32-unc://``, ``posix:``, ``uri:`` or ``logical:``; null if empty."""
    raw = F.trim(c)
    slashed = F.replace(raw, F.lit("\\"), F.lit("/"))
    plain = F.when(slashed.rlike("(?i)^//\\?/unc/"), F.concat(F.lit("//"), F.substring(slashed, 9, 1 << 30))).when(slashed.rlike("^//[?.]/"), F.substring(slashed, 5, 1 << 30)).otherwise(slashed)
    drive = F.lower(F.substring(plain, 1, 2))
    windows = F.lower(_segments(F.substring(plain, 3, 1 << 30), True))
    unc, posix, logical = F.lower(_segments(plain, True)), _segments(plain, True), _segments(plain, False)
    host = F.lower(F.regexp_extract(raw, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.substring(raw, F.length(host) + 1, F.lit(1 << 30))
    return (
        F.when(plain.rlike("^[A-Za-z]:/"), F.concat(F.lit("win32:"), drive, F.lit("/"), windows))
        .when(plain.startswith("//"), F.when(unc != "", F.concat(F.lit("win32-unc://"), unc)))
        .when(plain.startswith("/"), F.concat(F.lit("posix:/"), posix))
        .when(host != "", F.concat(F.lit("uri:"), host, F.when(rest == "", F.lit("/")).otherwise(rest)))
        .when(logical != "", F.concat(F.lit("logical:"), logical))
    )


def iso_timestamp(c: Column) -> Column:
    """The time of a text in the one accepted form, ``YYYY-MM-DDTHH:MM:SS.mmmZ``; null for any other text."""
    shaped = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"), c)
    return F.try_to_timestamp(shaped, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))


def iso_text(c: Column) -> Column:
    """A time in that form."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
