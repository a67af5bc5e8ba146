"""Per-tenant rates: what ingest may take now, and what scans may still read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class TokenBucket:
    """Fills at a rate up to one second's worth (or a capacity of its own)."""

    rate: float
    at_ns: int
    capacity: float | None = None

    def __post_init__(self):
        self.capacity = self.rate if self.capacity is None else self.capacity
        self.tokens = self.capacity

    def _fill(self, now_ns: int) -> None:
        self.tokens = min(self.capacity, self.tokens + self.rate * max(0, now_ns - self.at_ns) / 1e9)
        self.at_ns = max(self.at_ns, now_ns)

    def take(self, amount: float, now_ns: int) -> bool:
        """Take an amount known beforehand, or nothing."""
        self._fill(now_ns)
        if amount > self.tokens:
            return False
        self.tokens -= amount
        return True

    def charge(self, amount: float, now_ns: int) -> None:
        """Charge what a scan turned out to read; the debt goes no deeper than the capacity."""
        self._fill(now_ns)
        self.tokens = max(-self.capacity, self.tokens - amount)

    def open(self, now_ns: int) -> bool:
        """Whether a scan may begin: not while there is debt, and never at a rate of 0."""
        self._fill(now_ns)
        return self.rate > 0 and self.tokens >= 0

    def change(self, rate: float, now_ns: int) -> None:
        """A new rate from now on; what is left stays, up to the new capacity, and so does a debt."""
        self._fill(now_ns)
        self.rate = self.capacity = rate
        self.tokens = min(self.tokens, self.capacity)


class Quotas:
    """Buckets of all tenants; a rate of none is no limit."""

    def __init__(self):
        self.buckets: dict[tuple[str, str], TokenBucket] = {}

    def bucket(self, tenant: str, kind: str, rate: float | None, now_ns: int) -> TokenBucket | None:
        if rate is None:
            return None
        found = self.buckets.setdefault((tenant, kind), TokenBucket(rate, now_ns))
        if found.rate != rate:
            found.change(rate, now_ns)
        return found

    def remaining(self, tenant: str, now_ns: int) -> dict[str, float]:
        out = {}
        for (name, kind), b in self.buckets.items():
            if name == tenant:
                b._fill(now_ns)
                out[kind] = b.tokens
        return out
