"""Settings that are read, merged and checked before anything runs: build policy, limits, rights, and places."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from tessera.functions.ids import digest
from tessera.operators.visibility import MODES, Principal
from tessera.sources.markdown import IGNORED

_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._:-]{0,127}")

# fixed values: names of files that a published folder must not hold
ARTIFACTS = [".7z", ".docx", ".gz", ".pages", ".pdf", ".pptx", ".rar", ".tar", ".xlsx", ".zip"]
KEYS = [".key", ".p12", ".pem", ".pfx", ".private"]
PRIVATE_FOLDERS = [".obsidian", "attachments", "backup", "backups", "notes", "obsidian vault", "vault"]
CREDENTIALS = re.compile(r"\.env.*|\.npmrc|\.pypirc|credentials?\.json|id_(?:dsa|ecdsa|ed25519|rsa)|secrets?\.json|service-account(?:[._-][^.]+)*\.json", re.I)


@dataclass(frozen=True)
class BuildPolicy:
    """How a source is scanned and compiled; its hash decides whether earlier work may be reused."""

    most_files: int = 100_000
    most_bytes: int = 8 << 20
    ignored: Sequence[str] = tuple(IGNORED)
    chunk: int = 800
    overlap: int = 80
    most_deltas: int = 8
    most_replaced: float = 0.35
    journal: int = 10_000

    def __post_init__(self) -> None:
        wrong = [
            self.most_files < 1 and "most_files must be positive", self.most_bytes < 1 and "most_bytes must be positive", self.chunk < 200 and "chunk must be 200 at least",
            not 0 <= self.overlap <= self.chunk // 3 and "overlap must lie between 0 and a third of chunk", self.most_deltas < 1 and "most_deltas must be positive",
            not 0 < self.most_replaced <= 1 and "most_replaced must lie in (0, 1]", self.journal < 10 and "journal must be 10 at least",
        ]
        if any(wrong):
            raise ValueError("; ".join(w for w in wrong if w))

    @classmethod
    def merged(cls, overrides: Mapping[str, object] | None = None) -> BuildPolicy:
        """The defaults with overrides; ignored folders add up."""
        given = dict(overrides or {})
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        if "ignored" in given:
            given["ignored"] = tuple(dict.fromkeys([*IGNORED, *given["ignored"]]))
        return replace(cls(), **given)

    def hash(self, source: str, embedding: dict | None = None, version: str = "1", project: str | None = None, scope: str | None = None) -> str:
        """Changes with anything that changes what compiling gives."""
        scan = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "journal"} | {"ignored": sorted(self.ignored)}
        return digest({"version": version, "scan": scan, "source": source, "project": project, "scope": scope, "embedding": embedding})


#: Name, default, least and greatest value of each limit.
LIMITS = [
    ("MAX_FILES", 25_000, 1, 250_000), ("MAX_FILE_CHARS", 5_000_000, 1_000, 20_000_000), ("CHUNK", 700, 200, 2_000), ("OVERLAP", 80, 0, 400),
    ("CONTEXT", 2_000, 200, 16_000), ("SOURCE_CONTEXT", 700, 100, 4_000), ("CANDIDATES", 40, 1, 200), ("EVIDENCE", 8, 1, 50),
]


def limits(environment: Mapping[str, str], prefix: str = "TESSERA_") -> dict[str, int]:
    """Whole numbers within their bounds; a value that is not one is an error, not a default."""
    out = {}
    for name, default, low, high in LIMITS:
        raw = (environment.get(prefix + name) or "").strip()
        if raw and not re.fullmatch(r"\d{1,12}", raw):
            raise ValueError(f"{prefix + name} must be a whole number")
        value = int(raw) if raw else default
        if not low <= value <= high:
            raise ValueError(f"{prefix + name} must lie between {low} and {high}")
        out[name.lower()] = value
    if out["overlap"] > out["chunk"] // 3:
        raise ValueError(f"{prefix}OVERLAP must be at most a third of {prefix}CHUNK")
    return out


def principal(environment: Mapping[str, str], sources: Sequence[str], projects: Sequence[str] = (), prefix: str = "TESSERA_") -> Principal:
    """The rights that the environment grants: parts of what is configured, never more; unset means all of it."""

    def listed(name: str) -> list[str] | None:
        raw = environment.get(prefix + name)
        return None if raw is None or not raw.strip() else [x.strip() for x in raw.split(",") if x.strip()]

    def part(name: str, whole: Sequence[str]) -> tuple[str, ...]:
        asked = listed(name)
        if asked is None:
            return tuple(dict.fromkeys(whole))
        if any(not _ID.fullmatch(a) or a not in whole for a in asked):
            raise ValueError(f"{prefix + name} names what is not configured")
        return tuple(dict.fromkeys(asked))

    modes = listed("ALLOWED_MODES") or list(MODES)
    if any(m not in MODES for m in modes):
        raise ValueError(f"{prefix}ALLOWED_MODES has an unknown mode")
    return Principal(tuple(dict.fromkeys(modes)), part("ALLOWED_SOURCES", sources), part("ALLOWED_PROJECTS", projects), tuple(listed("INCLUDED_PATHS") or ()), tuple(listed("EXCLUDED_PATHS") or ()))


def isolated(output: str, inputs: Sequence[str]) -> None:
    """An error if an output folder lies in an input folder, or the other way; links are followed where they can be."""
    plain = lambda p: os.path.realpath(p) if "://" not in p else p.rstrip("/")
    own = plain(output)
    for i in map(plain, inputs):
        if (own + "/").startswith(i + "/") or (i + "/").startswith(own + "/"):
            raise ValueError(f"{output} and {i} overlap")


def path_fault(path: str) -> str | None:
    """Why a path has no place in a published folder; None if it has."""
    if not path:
        return "empty path"
    if "\\" in path or re.search(r"[\x00-\x1f\x7f]", path):
        return "unsafe path"
    segments = path.split("/")
    if path.startswith("/") or any(s in ("", ".", "..") for s in segments):
        return "not a canonical relative path"
    if any(s.lower() in PRIVATE_FOLDERS for s in segments):
        return "inside a personal folder"
    name = segments[-1].lower()
    if CREDENTIALS.fullmatch(name) and name != ".env.example":
        return "a file of credentials"
    extension = os.path.splitext(name)[1]
    if extension in ARTIFACTS:
        return "a document or archive"
    return "a key" if extension in KEYS else None


def audited_text(name: str, raw: bytes) -> str:
    """The text of a file; an error if it is not UTF-8 or has control characters."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        raise ValueError(f"{name} is not UTF-8 text") from None
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", text):
        raise ValueError(f"{name} has control characters")
    return text


def checked_counts(value: object, names: Sequence[str]) -> dict[str, int]:
    """Saved counts by name: all there, no others, whole numbers that are not negative."""
    if not isinstance(value, Mapping) or set(value) != set(names):
        raise ValueError("the counts are not those expected")
    if any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in value.values()):
        raise ValueError("a count is no whole number")
    return {n: value[n] for n in names}
