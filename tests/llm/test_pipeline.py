"""The pipeline against its stages done by brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from timberline.llm import bpe, toxicity

from . import common as C
from .test_operators import brute_components, families, toxic_rows


def brute_cut(rows):
    least = {}
    for d, t in rows:
        raw = t.encode()
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if least[raw[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        out.append((d, bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def leaks(text, item):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", C.lower(t))
    x, w = norm(item), norm(text)
    grams = lambda v: Counter(tuple(v[j : j + 5]) for j in range(len(v) - 4))
    a = grams(x)
    return any(sum((a & (b := grams(w[p : p + len(x)]))).values()) >= 0.8 * sum((a | b).values()) for p in range(len(w) - len(x) + 1))


def test_pipeline_matches_brute_force(spark, tmp_path):
    r = random.Random(11)
    rows, labels = toxic_rows(160)
    items = [(i, " ".join("".join(r.choice("bcdfgh") + r.choice("aeiou") for _ in range(3)) for _ in range(20))) for i in range(4)]
    rows += [(1000 + d, *x) for d, *x in families(12, (20, 40, 100))]
    shared = rows[1][1][:150]
    rows += [(3000 + i, f"{i} opening words {shared} closing words {i}", "en", "a", 1) for i in range(5)]
    rows += [(4000 + i, f"text number {i} before {items[i][1]} and after", "en", "a", 1) for i in range(4)]
    rows += [(5000, None, None, None, None), (5001, "", "en", "a", 0)]
    C.frame(spark, rows, False).write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scorer = toxicity.Scorer(toxicity.fit(docs, marks))
    left = [x for x in rows if scorer.score(x[1]) < toxicity.PREDICT_AT]
    assert len(left) < len(rows)
    roots = {c for _, _, c in brute_components(left)}
    cut = brute_cut([(d, t or "") for d, t, *_ in left if d in roots])
    clean = [(d, t) for d, t in cut if not any(leaks(t, item) for _, item in items)]
    assert len(clean) < len(cut) < len(left)
    codec = bpe.Codec(bpe.default_tokenizer_path())
    want = []
    for d, t in clean:
        e = codec.tokenizer.encode(t, add_special_tokens=False)
        ids, text = np.array(e.ids, "<u4").tobytes(), codec.tokenizer.decode(e.ids, skip_special_tokens=False)
        want.append((d, len(e.ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = sorted(tuple(x)[:4] for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
    assert corpus_pipeline.ORACLE_SQL is None
