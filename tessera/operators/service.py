"""Writes as a service: capabilities, review before approval, one-time decisions, commit, and the wait until it can be found.

Everything here runs on the driver, for one document at a time.
"""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from tessera.functions.ids import digest
from tessera.operators.visibility import Principal
from tessera.operators.writes import LEVELS, Proposal, Writer, line_diff, propose

PROTOCOL = "controlled-write-v1"
# fixed values: what a server may offer
CAPABILITIES = [
    "proposal.correction", "proposal.create", "proposal.delete", "diff.structured", "approval.bound-token",
    "write.cas", "write.atomic", "write.rollback", "audit.hash-chain", "reingest.await-searchable",
]
MOST_PROPOSAL_BYTES = 8 << 20


def _known(names: Sequence[str]) -> list[str]:
    odd = [n for n in names if n not in CAPABILITIES]
    if odd:
        raise ValueError(f"unknown capability {odd[0]}")
    return list(dict.fromkeys(names))


def offer(server: str, supported: Sequence[str] = CAPABILITIES, most_bytes: int = MOST_PROPOSAL_BYTES) -> dict:
    """What a server can do; approval is always required."""
    if not server.strip() or len(server) > 256 or most_bytes < 1:
        raise ValueError("the server's name or size limit is not valid")
    return {"protocol": PROTOCOL, "server": server, "supported": _known(supported), "most_bytes": most_bytes, "approval_required": True}


def negotiate(client: Mapping, server: Mapping) -> dict:
    """What both sides can do, and what the client needs and does not get; accepted if that is nothing."""
    required = _known(client["required"])
    if client["protocol"] != PROTOCOL or server["protocol"] != PROTOCOL:
        return {"accepted": False, "common": [], "missing": required}
    supported = _known(client["supported"])
    common = [c for c in supported if c in server["supported"]]
    missing = [c for c in required if c not in common]
    return {"accepted": not missing, "common": common, "missing": missing}


@dataclass(frozen=True)
class Review:
    """What a person is asked to decide on, bound to its content by hash."""

    id: str
    kind: str
    source: str
    path: str
    level: str
    text: str
    expires: float
    binding: str


def render(kind: str, source: str, p: Proposal) -> str:
    """A proposal as text to read: what, where, why, how risky, and the changed lines."""
    diff = line_diff(p.before, p.after)
    head = [f"{kind} of {source}: {p.path}", f"operation: {p.operation}", f"risk: {p.level} ({', '.join(p.reasons) or 'none'})", f"rationale: {p.rationale}", f"lines: +{diff.inserted} -{diff.deleted}" + (" (bounded)" if diff.bounded else "")]
    for old, new, lines in diff.hunks:
        head += [f"@@ -{old} +{new} @@", *lines]
    return "\n".join(head)


@dataclass(frozen=True)
class Decision:
    review: str
    binding: str
    approved: bool
    by: str


class Broker:
    """Decisions of people on exact reviews: each can be made once, and taken once."""

    def __init__(self, ask: Callable[[Review], Decision | None]):
        self._ask, self._taken = ask, set()

    def decide(self, review: Review) -> Decision:
        if review.id in self._taken:
            raise PermissionError("the review was decided before")
        self._taken.add(review.id)
        got = self._ask(review)
        if got is None or not got.approved:
            raise PermissionError("not approved")
        if (got.review, got.binding) != (review.id, review.binding) or not got.by.strip():
            raise PermissionError("the decision is on something else")
        return got


def authorized(principal: Principal | None, source: str, path: str) -> None:
    """An error unless the principal may write this document."""
    if principal is None:
        return
    under = lambda prefixes: any((path + "/").startswith(p.strip("/") + "/") for p in prefixes)
    if source not in principal.sources or (principal.include and not under(principal.include)) or under(principal.exclude):
        raise PermissionError("not authorized")


@dataclass
class WriteService:
    """Prepare, approve and commit; a prepared write waits for a limited time, and at most ``capacity`` of them wait."""

    writers: Mapping[str, Writer]
    broker: Broker
    reingest: Callable[[str, str], None] | None = None
    seconds: float = 600
    capacity: int = 32
    allow_critical: bool = False
    most_bytes: int = MOST_PROPOSAL_BYTES
    _pending: dict = field(default_factory=dict)

    def _store(self, source: str, kind: str, p: Proposal, extra: dict | None, now: float) -> Review:
        self._pending = {k: v for k, v in self._pending.items() if v[0].expires > now}
        if len(self._pending) >= self.capacity:
            raise RuntimeError("too many prepared writes")
        name, expires = f"prepared-{secrets.token_hex(16)}", now + self.seconds
        binding = digest({"id": name, "kind": kind, "source": source, "proposal": p.binding(), "expires": expires})
        review = Review(name, kind, source, p.path, p.level, render(kind, source, p), expires, binding)
        self._pending[name] = (review, p, extra)
        return review

    def prepare(self, source: str, path: str, after: str | None, rationale: str, principal: Principal | None = None, now: float | None = None) -> Review:
        """A review of a write; critical ones are refused unless they are allowed."""
        if source not in self.writers:
            raise ValueError("the source cannot be written")
        authorized(principal, source, path)
        if after is not None and len(after.encode()) > self.most_bytes:
            raise ValueError("the proposal is too large")
        now = time.time() if now is None else now
        p = propose(path, self.writers[source].read(path), after, rationale, now)
        if p.level == LEVELS[-1] and not self.allow_critical:
            raise PermissionError("critical writes are disabled")
        return self._store(source, "write", p, None, now)

    def prepare_rollback(self, source: str, receipt: Mapping, reason: str, principal: Principal | None = None, now: float | None = None) -> Review:
        authorized(principal, source, receipt["path"])
        now = time.time() if now is None else now
        p = propose(receipt["path"], receipt["after"], receipt["before"], reason, now)
        return self._store(source, "rollback", p, dict(receipt), now)

    def commit(self, prepared: str, now: Callable[[], float] = time.time) -> dict:
        """Ask for the decision, then write; a prepared write is taken once, whatever comes of it."""
        review, p, receipt = self._pending.pop(prepared, (None, None, None))
        if review is None:
            raise PermissionError("nothing of that name is prepared")
        writer, decision = self.writers[review.source], self.broker.decide(review)
        if now() >= review.expires:
            raise PermissionError("the prepared write expired")
        writer.ledger.append({"kind": "approved", "review": review.id, "by": decision.by})
        if review.kind == "rollback":
            writer.rollback(receipt)
            return {"path": p.path, "state": "rolled back"}
        token = writer.approvals.grant(p, now())
        again = None if self.reingest is None else (lambda path: self.reingest(review.source, path))
        return writer.commit(p, token, again, now())


@dataclass(frozen=True)
class Outcome:
    """Whether the index came to show a write: what was expected, what was last seen, how often and how long was asked."""

    expected: str
    observed: str
    version: str | None
    searchable: bool
    timed_out: bool
    attempts: int
    seconds: float
    error: str | None = None


def await_visible(request: Callable[[], None], observe: Callable[[], Mapping], version: str | None, timeout: float = 5.0, every: float = 0.025, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Outcome:
    """Ask for re-ingestion, then look until the version can be searched (None: until it is gone) or time is up.

    ``observe`` gives state (present or absent), version and searchable. A failing request or look ends the wait with
    its error's name; the write itself stands.
    """
    if not 0 < timeout <= 60 or not 0 < every <= timeout:
        raise ValueError("the timeout must lie in (0, 60] and the interval within it")
    expected, began, tries, seen = ("absent" if version is None else "present"), clock(), 0, {"state": "unknown", "version": None, "searchable": False}
    try:
        request()
        while True:
            tries += 1
            seen = observe()
            if (seen["state"] == "present") != (seen["version"] is not None):
                raise ValueError("a present document has a version, an absent one has none")
            done = seen["state"] == expected and seen["version"] == version and (seen["searchable"] if version else not seen["searchable"])
            late = clock() - began >= timeout
            if done or late:
                return Outcome(expected, seen["state"], seen["version"], bool(seen["searchable"]), late and not done, tries, clock() - began)
            sleep(every)
    except Exception as e:  # the caller is told, and keeps its receipt
        return Outcome(expected, seen["state"], seen["version"], bool(seen["searchable"]), False, tries, clock() - began, type(e).__name__)


def await_stream(query, version: str | None, observe: Callable[[], Mapping], timeout: float = 5.0) -> Outcome:
    """:func:`await_visible` for a streaming query: it processes all there is, then is looked at."""
    return await_visible(query.processAllAvailable, observe, version, timeout)


__all__ = ["Broker", "Decision", "Outcome", "Review", "WriteService", "authorized", "await_stream", "await_visible", "negotiate", "offer", "render"]
