import pytest

from timberline.api.metrics import Metrics
from timberline.operators.policies import Policies, tenant_name
from timberline.operators.quotas import Quotas, TokenBucket

S = 10**9


def test_buckets():
    b = TokenBucket(100, 0)
    assert b.take(100, 0) and not b.take(1, 0) and b.take(50, S // 2) and not b.take(60, S // 2)
    b.charge(10_000, S)
    assert b.tokens == -100 and not b.open(S) and not b.open(2 * S - 1) and b.open(2 * S) and not TokenBucket(0, 0).open(S)


def test_quotas_follow_rates():
    q = Quotas()
    assert q.bucket("t", "ingest", None, 0) is None
    q.bucket("t", "ingest", 10, 0).take(4, 0)
    assert q.remaining("t", 0) == {"ingest": 6} and q.bucket("t", "ingest", 20, 0).tokens == 6 and q.remaining("u", 0) == {}
    q.bucket("t", "query", 10, 0).charge(15, 0)
    assert q.bucket("t", "query", 100, 0).tokens == -5 and q.remaining("t", S)["query"] == 95


def test_tenants_and_policies():
    assert tenant_name(None, "d") == "d" and tenant_name("a_B-9") == "a_B-9"
    for bad in (None, "", " ", "a/b", "x" * 65):
        with pytest.raises(ValueError):
            tenant_name(bad)
    with pytest.raises(PermissionError):
        tenant_name("x", allowed=frozenset({"y"}))
    p = Policies()
    p.put("t", "7d", max_streams=5)
    assert p.get("t")[1] == "7d" and p.floor("t", 8 * 86400 * S) == 86400 * S and p.floor("other", 0) is None
    with pytest.raises(ValueError):
        p.put("t", "soon")
    assert p.delete("t") and not p.delete("t")


def test_metrics_text():
    m = Metrics()
    m.observe("q", 10, 0.2)
    m.observe("q", 5, 100)
    text = m.text()
    assert 'ingested_rows_total{query="q"} 15' in text and 'batch_seconds_bucket{query="q",le="0.5"} 1' in text and 'batch_seconds_bucket{query="q",le="+Inf"} 2' in text
