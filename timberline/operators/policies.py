"""Tenant policies and delete requests as small documents with versions; usage of a tenant."""

from __future__ import annotations

import hmac
import re
import uuid
from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.versions import Document
from .masks import MAX_DELETES, PROCESSED, RECEIVED, Delete, delete_query, floor, retention_ns

POLICY = "tenant string, retention string, ingest_rate long, query_rate long, max_streams long, updated_at long"


def tenant_name(text: str | None, default: str | None = None, allowed: frozenset[str] | None = None) -> str:
    """A valid tenant, or the default where none is named."""
    text = default if text is None else text
    if text is None or not re.fullmatch("[A-Za-z0-9_-]{1,64}", text):
        raise ValueError(f"invalid tenant {text!r}")
    if allowed is not None and text not in allowed:
        raise PermissionError(f"tenant {text!r} is not allowed")
    return text


def authorized(header: str | None, token: str | None) -> bool:
    """Whether a header bears the administrator's token, compared in constant time; without a token nobody is."""
    return bool(token) and hmac.compare_digest((header or "").encode(), f"Bearer {token}".encode())


class Policies:
    """Whole-document policies by tenant; a tenant without one keeps everything."""

    def __init__(self, rows: list[tuple] = (), version: int = 0):
        self.rows, self.version = {r[0]: tuple(r) for r in rows}, version

    @classmethod
    def load(cls, document: Document) -> Policies:
        version, rows = document.read()
        return cls(rows or (), version)

    def save(self, document: Document) -> None:
        """Conflict where another writer has saved since this was loaded."""
        self.version = document.write([self.rows[t] for t in sorted(self.rows)], self.version)

    def put(self, tenant: str, retention: str, ingest_rate: int | None = None, query_rate: int | None = None, max_streams: int | None = None, updated_at: int = 0) -> None:
        retention_ns(retention)
        self.rows[tenant_name(tenant)] = (tenant, retention, ingest_rate, query_rate, max_streams, updated_at)

    def get(self, tenant: str) -> tuple | None:
        return self.rows.get(tenant)

    def delete(self, tenant: str) -> bool:
        return self.rows.pop(tenant, None) is not None

    def floor(self, tenant: str, now_ns: int) -> int | None:
        row = self.rows.get(tenant)
        return floor(now_ns, retention_ns(row[1])) if row else None


class Deletes:
    """Delete requests of all tenants: submitted, listed, cancelled, and processed once the rows are gone."""

    def __init__(self, rows: list[Delete] = (), version: int = 0):
        self.rows, self.version = list(rows), version

    @classmethod
    def load(cls, document: Document) -> Deletes:
        version, rows = document.read()
        return cls([Delete(**r) for r in rows or ()], version)

    def save(self, document: Document) -> None:
        """Conflict where another writer has saved since this was loaded."""
        self.version = document.write([asdict(d) for d in self.rows], self.version)

    def submit(self, tenant: str, query: str, start_ns: int, end_ns: int | None, now_ns: int) -> Delete:
        end_ns = now_ns if end_ns is None else end_ns
        delete_query(query)
        if end_ns <= start_ns:
            raise ValueError("a delete ends after its start")
        if sum(d.tenant == tenant for d in self.rows) >= MAX_DELETES:
            raise ValueError(f"more than {MAX_DELETES} deletes")
        self.rows.append(Delete(uuid.uuid4().hex, tenant_name(tenant), query, start_ns, end_ns, now_ns, RECEIVED))
        return self.rows[-1]

    def list(self, tenant: str) -> list[Delete]:
        return [d for d in self.rows if d.tenant == tenant]

    def cancel(self, tenant: str, request_id: str) -> bool:
        before = len(self.rows)
        self.rows = [d for d in self.rows if (d.tenant, d.request_id) != (tenant, request_id)]
        return len(self.rows) < before

    def processed(self, ids: set[str]) -> None:
        self.rows = [replace(d, status=PROCESSED) if d.request_id in ids else d for d in self.rows]


def usage(logs: DataFrame) -> DataFrame:
    """tenant, streams, entries, bytes."""
    per = logs.groupBy("tenant", L.labels_key(F.col("labels")).alias("series")).agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes"))
    return per.groupBy("tenant").agg(F.count("*").alias("streams"), F.sum("n").alias("entries"), F.sum("bytes").alias("bytes"))
