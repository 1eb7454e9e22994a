"""Controlled writes: proposals, line diffs, risk, approval, commit with compare-and-swap, and a hash-chained ledger.

These run on the driver, one document at a time; they touch no Spark data.
"""

from __future__ import annotations

import difflib
import os
import re
import secrets
import time
import uuid
from dataclasses import asdict, dataclass, field
from pathlib import Path

from tessera.functions.ids import digest, sign, signed_by

LEVELS = ("low", "medium", "high", "critical")
#: Above so many cells of the comparison table a diff is one replacement between common ends.
DIFF_CELLS = 250_000


@dataclass(frozen=True)
class Diff:
    inserted: int
    deleted: int
    hunks: list[tuple[int, int, list[str]]]
    bounded: bool


def line_diff(before: str | None, after: str | None, context: int = 2) -> Diff:
    """Changed lines with some context; (first old line, first new line, marked lines) per hunk."""
    a, b = (before or "").split("\n") if before is not None else [], (after or "").split("\n") if after is not None else []
    bounded = len(a) * len(b) > DIFF_CELLS
    if bounded:
        head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        codes = [("equal", 0, head, 0, head), ("replace", head, len(a) - tail, head, len(b) - tail), ("equal", len(a) - tail, len(a), len(b) - tail, len(b))]
        groups = [[("equal", max(0, head - context), head, max(0, head - context), head), codes[1], ("equal", len(a) - tail, min(len(a), len(a) - tail + context), len(b) - tail, 0)]]
    else:
        match = difflib.SequenceMatcher(None, a, b, autojunk=False)
        codes, groups = match.get_opcodes(), match.get_grouped_opcodes(context)
    deleted = sum(c[2] - c[1] for c in codes if c[0] in ("replace", "delete"))
    inserted = sum(c[4] - c[3] for c in codes if c[0] in ("replace", "insert"))
    hunks = []
    for g in groups if deleted or inserted else []:
        lines: list[str] = []
        for kind, i1, i2, j1, j2 in g:
            if kind == "equal":
                lines += [" " + x for x in a[i1:i2]]
            else:
                lines += ["-" + x for x in a[i1:i2]] + ["+" + x for x in b[j1:j2]]
        hunks.append((g[0][1] + 1, g[0][3] + 1, lines))
    return Diff(inserted, deleted, hunks, bounded)


def _front(text: str | None) -> str:
    m = re.match(r"---\r?\n.*?\r?\n---(?=\r?\n|$)", text or "", re.S)
    return m.group() if m else ""


def risk(path: str, operation: str, before: str | None, after: str | None, diff: Diff) -> tuple[str, list[str]]:
    """Level and reasons: hidden paths and near-total removals are critical; deletions, frontmatter and large edits high."""
    level, reasons = "medium", []
    raise_to = lambda new: max(level, new, key=LEVELS.index)
    if any(p.startswith(".") for p in path.split("/")):
        level, reasons = "critical", ["hidden_or_control_path"]
    if operation == "delete":
        return raise_to("high"), sorted([*reasons, "document_deletion"])
    if operation == "create":
        return level, sorted([*reasons, "new_document"])
    old, new = max(1, len((before or "").encode())), len((after or "").encode())
    lost = max(0, old - new) / old
    if _front(before) != _front(after):
        level = raise_to("high")
        reasons.append("frontmatter_changed")
    if lost >= 0.8:
        level = "critical"
        reasons.append("most_content_removed")
    elif lost >= 0.5 or diff.inserted + diff.deleted > 100:
        level = raise_to("high")
        reasons.append("large_content_removal" if lost >= 0.5 else "large_edit")
    elif not reasons:
        small = diff.inserted + diff.deleted <= 4 and lost <= 0.1
        level, reasons = ("low", ["small_local_edit"]) if small else (level, ["document_content_changed"])
    return level, sorted(set(reasons))


@dataclass(frozen=True)
class Proposal:
    """An edit bound to its content by hash."""

    path: str
    operation: str
    rationale: str
    before: str | None
    after: str | None
    created: float
    level: str
    reasons: list[str]
    id: str = ""

    def binding(self) -> str:
        return digest({k: v for k, v in asdict(self).items() if k != "id"})


def propose(path: str, before: str | None, after: str | None, rationale: str, now: float | None = None) -> Proposal:
    if before == after:
        raise ValueError("nothing changes")
    clean = path.replace("\\", "/")
    if clean.startswith("/") or ".." in clean.split("/") or "\0" in clean:
        raise ValueError("path leaves the source")
    operation = "create" if before is None else "delete" if after is None else "replace"
    level, reasons = risk(clean, operation, before, after, line_diff(before, after))
    p = Proposal(clean, operation, rationale, before, after, time.time() if now is None else now, level, reasons)
    return Proposal(**(asdict(p) | {"id": p.binding()}))


class Approvals:
    """Signed one-time approvals of single proposals, up to a risk level and for a limited time."""

    def __init__(self, key: bytes, ceiling: str = "high", seconds: float = 600):
        self.key, self.ceiling, self.seconds, self._used = key, ceiling, seconds, set()

    def grant(self, p: Proposal, now: float | None = None) -> dict:
        if LEVELS.index(p.level) > LEVELS.index(self.ceiling):
            raise PermissionError(f"risk {p.level} is above {self.ceiling}")
        body = {"proposal": p.binding(), "level": p.level, "expires": (time.time() if now is None else now) + self.seconds, "nonce": secrets.token_hex(8)}
        return body | {"signature": sign(body, self.key)}

    def claim(self, token: dict, p: Proposal, now: float | None = None) -> None:
        body = {k: v for k, v in token.items() if k != "signature"}
        if not signed_by(body, self.key, token.get("signature", "")):
            raise PermissionError("signature")
        if token["proposal"] != p.binding():
            raise PermissionError("approval is for another proposal")
        if (time.time() if now is None else now) > token["expires"]:
            raise PermissionError("approval expired")
        if token["nonce"] in self._used:
            raise PermissionError("approval was used")
        self._used.add(token["nonce"])


class Ledger:
    """Append-only entries, each bound to the one before."""

    def __init__(self) -> None:
        self.entries: list[dict] = []

    def append(self, event: dict) -> dict:
        body = {"sequence": len(self.entries), "previous": self.entries[-1]["hash"] if self.entries else "", "event": event}
        entry = body | {"hash": digest(body)}
        self.entries.append(entry)
        return entry

    def verify(self) -> bool:
        before = ""
        for i, e in enumerate(self.entries):
            body = {k: v for k, v in e.items() if k != "hash"}
            if e["sequence"] != i or e["previous"] != before or e["hash"] != digest(body):
                return False
            before = e["hash"]
        return True

    def compact(self, keep: int) -> None:
        """Keep the last entries, chained anew."""
        events = [e["event"] for e in self.entries[-keep:]]
        self.entries = []
        for e in events:
            self.append(e)


@dataclass
class Writer:
    """Commits approved proposals to a folder by compare-and-swap, and keeps what a rollback needs."""

    root: Path
    approvals: Approvals
    ledger: Ledger = field(default_factory=Ledger)

    def _at(self, path: str) -> Path:
        full = (self.root / path).resolve()
        if self.root.resolve() not in full.parents:
            raise PermissionError("path leaves the source")
        return full

    def read(self, path: str) -> str | None:
        p = self._at(path)
        return p.read_text(encoding="utf-8") if p.exists() else None

    def _put(self, path: str, text: str | None) -> None:
        p = self._at(path)
        if text is None:
            p.unlink()
            return
        p.parent.mkdir(parents=True, exist_ok=True)
        tmp = p.with_name(f".{uuid.uuid4().hex}.tmp")
        tmp.write_text(text, encoding="utf-8")
        os.replace(tmp, p)

    def commit(self, p: Proposal, token: dict, reingest=None, now: float | None = None) -> dict:
        """Write, log, and offer the path to ``reingest``; a failing one leaves a degraded receipt, not a lost write."""
        if self.read(p.path) != p.before:
            raise RuntimeError("the document changed since the proposal")
        self.approvals.claim(token, p, now)
        self.ledger.append({"kind": "begin", "proposal": p.id})
        self._put(p.path, p.after)
        if self.read(p.path) != p.after:
            raise RuntimeError("the write did not take")
        self.ledger.append({"kind": "commit", "proposal": p.id, "path": p.path})
        state = "visible"
        if reingest is not None:
            try:
                reingest(p.path)
            except Exception as e:  # the write stands; only its visibility is late
                state = f"degraded: {e}"
        return {"proposal": p.id, "path": p.path, "state": state, "before": p.before, "after": p.after}

    def rollback(self, receipt: dict) -> None:
        if self.read(receipt["path"]) != receipt["after"]:
            raise RuntimeError("the document changed since the commit")
        self._put(receipt["path"], receipt["before"])
        self.ledger.append({"kind": "rollback", "proposal": receipt["proposal"], "path": receipt["path"]})


@dataclass
class HostWriter(Writer):
    """Commits through a host application instead of a folder: ``host`` has read(path), write(path, text) and delete(path)."""

    host: object = None

    def read(self, path: str) -> str | None:
        return self.host.read(path)

    def _put(self, path: str, text: str | None) -> None:
        if text is None:
            self.host.delete(path)
        else:
            self.host.write(path, text)
