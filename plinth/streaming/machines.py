"""State machines of the update stream, as plain functions on small states; streams and batch jobs both run them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from plinth.operators import progress as G

OPEN_AFTER, RETRY_BASE, RETRY_CAP, RETRY_JITTER = 3, 30.0, 1800.0, 0.1
ESCALATE_SAMPLES, RELEASE_SECONDS, SAMPLE_SECONDS, STALE_SECONDS = 3, 60.0, 5.0, 15.0


def wait_of(exponent: int, unit: float = 0.5, base: float = RETRY_BASE, cap: float = RETRY_CAP, fraction: float = RETRY_JITTER) -> float:
    plain = min(base * 2.0 ** min(exponent, 62), cap)
    return min(cap, max(0.0, plain + plain * fraction * (2 * unit - 1)))


@dataclass(frozen=True)
class Retry:
    """failures in a row, circuit (closed, open, half_open) and when to try again."""

    failures: int = 0
    circuit: str = "closed"
    retry_at: float | None = None

    def failed(self, now: float, retryable: bool = True, unit: float = 0.5) -> Retry:
        n = self.failures + 1
        opened = n >= OPEN_AFTER or not retryable or self.circuit == "half_open"
        return Retry(n, "open" if opened else "closed", now + wait_of(n - 1, unit))

    def admit(self, now: float) -> tuple[bool, Retry]:
        """Whether a run may start; an open circuit lets one through after its delay."""
        if self.retry_at is not None and now < self.retry_at:
            return False, self
        if self.circuit == "half_open":
            return False, self
        return True, replace(self, circuit="half_open") if self.circuit == "open" else self

    def succeeded(self) -> Retry:
        return Retry()


@dataclass(frozen=True)
class Pressure:
    """Tier with hysteresis: it rises to the least of ESCALATE_SAMPLES samples above it, and falls by one after RELEASE_SECONDS below it.

    It lapses to none before a sample that comes STALE_SECONDS or more after the last one, or before it by the clock; a
    sample within SAMPLE_SECONDS of the last one doesn't count.
    """

    tier: int = 0
    above: tuple[int, ...] = ()
    quiet_since: float | None = None
    seen_at: float | None = None

    def sample(self, raw: int, now: float) -> Pressure:
        if self.seen_at is not None and now >= self.seen_at and now - self.seen_at < SAMPLE_SECONDS:
            return self
        if self.stale(now):
            return Pressure()._taken(raw, now)
        return self._taken(raw, now)

    def _taken(self, raw: int, now: float) -> Pressure:
        if raw > self.tier:
            above = (*self.above, raw)
            if len(above) >= ESCALATE_SAMPLES:
                return Pressure(min(above[-ESCALATE_SAMPLES:]), (), None, now)
            return replace(self, above=above, quiet_since=None, seen_at=now)
        if raw == self.tier:
            return replace(self, above=(), quiet_since=None, seen_at=now)
        since = now if self.quiet_since is None else self.quiet_since
        if now - since >= RELEASE_SECONDS:
            return Pressure(self.tier - 1, (), now, now)
        return replace(self, above=(), quiet_since=since, seen_at=now)

    def stale(self, now: float) -> bool:
        return self.seen_at is None or now < self.seen_at or now - self.seen_at >= STALE_SECONDS


@dataclass(frozen=True)
class Scope:
    """Pending paths of a root: collecting until the delay or freshness is over, then ready, running and cooling."""

    state: str = "idle"
    first_at: float | None = None
    deadline: float | None = None
    cool_until: float = 0.0
    pending: frozenset = field(default_factory=frozenset)
    captured: frozenset = field(default_factory=frozenset)

    def observe(self, path: str, now: float, delay: float) -> Scope:
        """One more path; a new event moves the deadline on, never past the freshness limit."""
        first = now if self.first_at is None else self.first_at
        state = self.state if self.state == "running" else "collecting"
        return replace(self, state=state, first_at=first, deadline=min(now + delay, first + G.FRESHNESS), pending=self.pending | {path})

    def evaluate(self, now: float, retry: Retry = Retry(), pressure: int = 0, critical: int = 2) -> str:
        """What holds the scope back, in order, or ready."""
        if self.state == "running":
            return "running"
        if not self.pending:
            return "idle"
        if retry.retry_at is not None and now < retry.retry_at:
            return "retry_wait"
        if pressure >= critical:
            return "pressure_hold"
        if now >= self.first_at + G.FRESHNESS:
            return "ready"
        if now < self.cool_until:
            return "cooling"
        if len(self.pending) >= G.MOST_PENDING:
            return "ready"
        if pressure > 0:
            return "pressure_wait"
        return "ready" if now >= self.deadline else "collecting"

    def start(self) -> Scope:
        return replace(self, state="running", captured=self.pending, pending=frozenset(), first_at=None, deadline=None)

    def complete(self, now: float, run_seconds: float, publish_seconds: float = 0.0) -> Scope:
        """Cools as long as the run took, at most COOLING_MAX and not past the freshness of what came meanwhile."""
        until = now + min(run_seconds + publish_seconds, G.COOLING_MAX)
        if self.first_at is not None:
            until = min(until, self.first_at + G.FRESHNESS)
        return replace(self, state="collecting" if self.pending else "idle", captured=frozenset(), cool_until=until)

    def release(self, now: float) -> Scope:
        """A cancelled run's paths are pending again."""
        pending = self.pending | self.captured
        first = now if self.first_at is None else self.first_at
        return replace(self, state="collecting" if pending else "idle", pending=pending, captured=frozenset(), first_at=first if pending else None, deadline=now if pending else None)

    def over_capacity(self, most: int = G.MOST_PENDING) -> bool:
        """More paths than are tracked: the root wants a full index instead."""
        return len(self.pending) > most


@dataclass(frozen=True)
class Activity:
    """A request: queued, active, then one end; the first end counts."""

    state: str = "queued"

    def move(self, to: str) -> Activity:
        done = ("succeeded", "failed", "cancelled", "queue_full", "deadline_exceeded")
        if self.state in done:
            return self
        if (self.state, to) in (("queued", "active"),) or to in done:
            return Activity(to)
        raise ValueError(f"{self.state} can't become {to}")


class Revisions:
    """A number that rises by one with each publication of a (root, source), above both sides' numbers."""

    def __init__(self) -> None:
        self._at: dict[tuple[str, str], int] = {}

    def publish(self, root: str, source: str, publication: int = 0, controller: int = 0) -> int:
        key = (root, source)
        self._at[key] = max(self._at.get(key, 0), publication, controller) + 1
        return self._at[key]

    def current(self, root: str, source: str) -> int:
        return self._at.get((root, source), 0)
