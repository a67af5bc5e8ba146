"""Each operator against a brute-force version, on odd rows and on small tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import bpe, decontam, htmltext, jaccard, langid, licenses, quality, sharding, suffix, toxicity
from timberline.llm import kernel as K

from . import common as C

SF = "/root/testdata/sf0.001"


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------- op1


def brute_repeats(rows):
    least = {}
    for d, t, *_ in rows:
        raw = (t or "").encode() if d is not None else b""
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            if least.get(w, d) >= d:
                least[w] = d
    out = defaultdict(list)
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone, end = bytearray(len(raw)), 0
        for p in range(len(raw) - 49) if d is not None else ():
            if least[raw[p : p + 50]] < d:
                for q in range(max(p, end), p + 50):
                    gone[q] = 1
                end = p + 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out[d].append((len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def overlapping_rows():
    r = random.Random(4)
    base = [(100 + i, prose(r, r.choice([5, 60, 300])), "en", "a", 1) for i in range(20)]
    cut = []
    for i in range(60):
        t = r.choice(base)[1]
        j = r.randrange(len(t))
        cut.append((200 + i, f"{prose(r, r.randrange(9))}é{t[j : j + r.randint(30, 120)]} {prose(r, 3)}", "en", "a", 1))
    return base + cut + [(400, "ab" * 300, None, None, None), (401, "ab" * 200, None, None, None), (402, "q" + "ab" * 24 + "z", None, None, None), (403, "é" * 60, None, None, None), (404, "xé" * 60, None, None, None)]


def test_repeats_match_brute_force(spark, monkeypatch):
    rows = C.odd_rows() + overlapping_rows()
    got = defaultdict(list)
    for r in suffix.digests(C.frame(spark, rows)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(rows)


@pytest.mark.parametrize("ids", [(1, 2, 1), (2, 1, 2), (1, 2, 2, 1, 3, 1)])
def test_doc_ids_that_come_again_within_a_chunk(spark, ids):
    passage = prose(random.Random(5), 60)
    rows = [(d, passage, "en", "a", 1) for d in ids]
    got = defaultdict(list)
    for r in suffix.digests(spark.createDataFrame(rows, C.SCHEMA).coalesce(1)).collect():
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(rows)


def test_rows_of_one_doc_id_with_different_texts(spark):
    r = random.Random(8)
    a, b, other = prose(r, 60, 90_000), prose(r, 60, 90_000), prose(r, 80, 90_000)
    rows = [(1, a, "en", "a", 1), (2, f"{a} {b}", "en", "a", 1), (2, other, "en", "a", 1), (2, other, "en", "a", 1), (3, b, "en", "a", 1), (3, f"{other[:200]} {b}", "en", "a", 1), (4, "", "en", "a", 0), (4, b, "en", "a", 1)]
    got = defaultdict(list)
    for x in suffix.digests(C.frame(spark, rows)).collect():
        got[x.doc_id].append((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256))
    want = brute_repeats(rows)
    assert {k: sorted(v) for k, v in got.items()} == want and sorted(n for _, n, _, _ in want[2])[:2] == [0, 0]
    left = sorted((x.doc_id, hashlib.sha256(x.text.encode()).hexdigest()) for x in suffix.without_repeats(C.frame(spark, rows)).collect())
    assert left == sorted((d, x[3]) for d, v in want.items() for x in v)


def test_a_passage_of_many_documents(spark, monkeypatch):
    """Met again in later chunks of a task, and with a smaller doc_id later on."""
    monkeypatch.setattr(K, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(K.chunks, "__defaults__", (2000,))
    r = random.Random(11)
    passage = prose(r, 50, 90_000)
    rows = [(900 - i, f"{prose(r, 3, 90_000)} {passage} {prose(r, 3, 90_000)}", "en", "a", 1) for i in range(80)]
    got = {x.doc_id: x.n_removed for x in suffix.digests(spark.createDataFrame(rows, C.SCHEMA).coalesce(1)).collect()}
    assert got == {d: v[0][1] for d, v in brute_repeats(rows).items()}


def test_text_without_repeats_keeps_columns_and_characters(spark):
    rows = C.odd_rows() + overlapping_rows()
    df = C.frame(spark, rows)
    out = suffix.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert {r.doc_id for r in out.where("text IS NULL").collect()} == {1}
    assert suffix.without_repeats(df.limit(0)).count() == 0 and suffix.digests(df.limit(0)).count() == 0


def test_cover_reaches_every_pair_of_phases():
    for i in range(31):
        for j in range(31):
            assert any((i + d) % 31 in suffix.COVER and (j + d) % 31 in suffix.COVER for d in range(31))


# ------------------------------------------------------------------- op2


def brute_measures(text):
    w = C.words(text)
    t = text or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = {i + j for i, g in enumerate(grams) if g in twice for j in range(3)}
    lines = [x for x in t.split("\n") if C.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_measures_match_brute_force(spark):
    rows = C.odd_rows() + [(50 + i, t, "en", "a", 1) for i, t in enumerate(["a\na\n\nb\na ", "a b c a b c", "x\r\nx\r\n", "\n", "a b c d\na b c d\n" * 3, "é\né", "# a"])]
    got = quality.judge(C.frame(spark, rows)).collect()
    want = sorted([(d, *brute_measures(t)) for d, t, *_ in rows], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=repr) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.judge(C.frame(spark, rows).limit(0)).count() == 0


def test_thresholds_follow_the_group(spark):
    r = random.Random(1)
    rows = [(i, prose(r, 80) + " #" * (60 if i % 2 else 0), "en", "coded" if i % 2 else "plain", 1) for i in range(600)] + [(1000, prose(r, 80) + " #" * 60, "en", "plain", 1)]
    kept = {x.doc_id: (x.kept, x.rules_failed) for x in quality.judge(C.frame(spark, rows)).collect()}
    assert kept[1][0] and kept[0][0] and not kept[1000][0] and "symbols" in kept[1000][1]  # 60 lone signs are also a repeat


def test_sketches_tighten_thresholds(spark):
    r = random.Random(2)
    text = lambda size: " ".join("".join(r.choices("abcdefghij", k=size + r.randrange(-1, 2))) for _ in range(60))
    rows = [(i, text(8 if i % 2 else 5), "de" if i % 2 else "en", "a", 1) for i in range(600)]
    rows += [(1000, text(9), "en", "a", 1), (1001, text(9), "de", "a", 1), (1002, text(5), "de", "a", 1), (1003, text(5), "en", "a", 1)]
    got = {x.doc_id: x.rules_failed for x in quality.judge(C.frame(spark, rows)).collect()}
    assert got[1000] == "long_words" and got[1002] == "short_words" and {got[1001], got[1003], got[0], got[1]} == {""}


def test_fences_differ_between_groups_of_the_tables(spark):
    """On the registered tables no rule has one threshold for all groups, and each rule rejects some."""
    rows = K.written(quality.measured(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "quality-test")
    at = quality.thresholds(rows).collect()
    for name, _, _ in quality.RULES:
        values = [x[f"at_{name}"] for x in at]
        assert len(set(values)) > len(values) / 2, name
    failed = [x.rules_failed for x in quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if not x.base_failed]
    assert 0 < sum(x != "" for x in failed) < 0.2 * len(failed)


# ------------------------------------------------------------------- op3


def test_an_item_of_many_words_takes_little_memory():
    import tracemalloc

    r = random.Random(3)
    item = prose(r, 20_000, 50_000)
    index = decontam.Index([(1, item)], 5)
    raw = f"{prose(r, 50, 50_000)} {item} {prose(r, 50, 50_000)}".encode()
    c = K.Chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0)
    words = K.Words(c, decontam._WORD)
    h = K.word_hashes(c, words)
    tracemalloc.start()
    found = next(index.search(c, words, h))
    assert found[:2] == (0, 0) and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()



def test_decontamination_matches_brute_force(spark):
    r = random.Random(2)
    items = [(i, prose(r, r.choice([3, 4, 5, 8, 20, 40, 41]), 3000).title()) for i in range(40)] + [(90, ""), (91, None), (92, "solo"), (None, "null id item with seven words here")]
    docs = []
    for i in range(80):
        t = prose(r, r.randint(0, 150), 3000).split()
        if i % 2:
            passage = (r.choice(items[:40])[1].lower() + ("," if i % 3 else "")).split()
            if i % 4 == 1 and len(passage) > 30:
                passage[r.choice([0, -1])] = "changed"
            at = r.randint(0, len(t))
            t[at:at] = passage
        docs.append((i, "  ".join(t), "en", "a", 1))
    docs += [(1000 + d if d is not None else None, *x) for d, *x in C.odd_rows()]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", C.lower(t or ""))
    want = {}
    for item, text in items:
        x = norm(text)
        if not x:
            continue
        k = min(5, len(x))
        a = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
        for doc, t, *_ in docs:
            w = norm(t)
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            hits = [p for p, g in enumerate(grams) if g in a]
            for p in sorted({h - j for h in hits for j in range(len(x) - k + 1) if 0 <= h - j <= len(w) - len(x)}):
                b = Counter(grams[p : p + len(x) - k + 1])
                s = sum((a & b).values()) / sum((a | b).values())
                if s >= 0.8 and s > want.get((doc, item), (0, 0))[0]:
                    want[doc, item] = (s, p)
    df, bench = C.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.similarity, x.first_word) for x in decontam.matches(df, bench).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.without_leaks(df.limit(0), bench).count() == 0


def test_index_finds_all_fingerprints_within_radius():
    r = random.Random(3)
    index = decontam.Index([(i, prose(r, 30)) for i in range(50)], 5)
    for i in range(50):
        for n in range(decontam.RADIUS + 1):
            p = int(index.prints[i])
            for b in r.sample(range(64), n):
                p ^= 1 << b
            assert i in index.near(np.array([p], np.uint64))[0]


# ------------------------------------------------------------------- op4

PAGES = {
    "<p>a<p>b<br>c": "a\n\nb\nc",
    "<ul><li>a<li>b<ol start=3><li>x<li value=9>y</ol><li>c</ul>": "• a\n• b\n    3. x\n    9. y\n• c",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>all of it</table>": "Name   Qty\napple  3\nall of it",
    "a <b>b</b>c  <i> d </i> e": "a bc d e",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "x<script>var a='<p>y</p>'</script><style>p{}</style><!-- c -->z": "xz",
    "<div hidden>a</div><p style='display: none'>b</p><span style=visibility:hidden>c<i style=visibility:visible>d</i></span>": "d",
    "<title>t</title>body": "body",
    "<details><summary>s</summary>x</details><details open><summary>s</summary>x</details>": "s\ns\nx",
    "1 &lt; 2 &amp;&copy &#x41; < 3": "1 < 2 &© A < 3",
    "<blockquote>q<p>r</blockquote>": "> q\n\n> r",
    "<dl><dt>t<dd>d</dl>": "t\n    d",
    "</div></p>a</b>": "a",
    "<p title='a>b'>c": "c",
    "<!doctype html><html><body>a</body></html>b": "ab",
    "<h1>A</h1><div>b</div><div>c</div>": "A\n\nb\nc",
}


@pytest.mark.parametrize("page", PAGES)
def test_html(page):
    assert htmltext.text_of(page) == PAGES[page]


def test_html_at_any_depth():
    deep = "<div>" * 5000
    assert htmltext.text_of(f"{deep}a<div hidden>SECRET</div>b") == "ab"
    assert htmltext.text_of(f"{deep}a<noscript>SECRET</noscript>b") == "ab"
    assert htmltext.text_of("<ul><li>" * 300 + "x").split()[-1] == "x"


def test_tables_align_across_rows_and_wide_characters():
    text = htmltext.text_of("<table><tr><td rowspan=2>AAAA<td>B<td>C<tr><td>D<td>E<tr><td>1<td>2<td>3</table>")
    assert text == "AAAA  B  C\n      D  E\n1     2  3"
    text = htmltext.text_of("<table><tr><td>日本<td>x<tr><td>abcd<td>y<tr><td>é<td>z</table>")
    assert text == "日本  x\nabcd  y\né     z"
    text = htmltext.text_of("<table><tr><td rowspan=0>a<td colspan=2>wide cell<tr><td>b<td>c<tr><td>d<td>e</table>")
    assert text.split("\n")[1:] == ["   b  c", "   d  e"]


def test_style_rules_hide():
    page = "<style>/* x */ .h, p#n{color:red;display:none} .s{display:none} @media print{.m{display:none}} div.s{display:block} i > b{display:none}</style>"
    body = "<span class='a h'>1</span><p id=n>2</p><p>3</p><div class=s>4</div><span class=s>5</span><span class=m>6</span><i><b>7</b></i>"
    assert htmltext.text_of(page + body).split() == ["3", "4", "67"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<table>", "<td>", "<tr>", "</table>", "<ul>", "<li>", "</ul>", "<div", ">", "<!--", "-->", "&", "a", " ", '"', "=", "<script>", "</script>", "<b>", "</b>", "<pre>", "\n", "<dd>", "</dd>", "<ol>", "</ol>"]), max_size=40))
def test_html_never_fails(parts):
    htmltext.text_of("".join(parts))


def test_html_rows(spark):
    rows = [(1, None), (2, ""), (2, "<p>x"), (None, "y"), (3, "<div>" * 5000 + "deep"), (4, "<p>w</p>" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' AS url", "1 AS text", "2 AS n_chars")
    got = {(r.page_id, r.n_chars, r.n_lines) for r in htmltext.extract(df).collect()}
    assert got == {(1, 0, 0), (2, 0, 0), (2, 1, 1), (None, 1, 1), (3, 4, 1), (4, 14998, 9999)}
    assert htmltext.extract(df.limit(0)).count() == 0


# ------------------------------------------------------------------- op5

tokens = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(tokens.path("word_bpe_49k.json"))


def check_codec(codec, texts):
    for t, (ids, decoded) in zip(texts, codec.run(texts), strict=True):
        e = codec.tokenizer.encode(t or "", add_special_tokens=False)
        assert ids == np.array(e.ids, "<u4").tobytes(), t
        assert decoded.decode() == codec.tokenizer.decode(e.ids, skip_special_tokens=False), t


def test_codec_on_odd_texts(codec):
    check_codec(codec, [t for _, t, *_ in C.odd_rows()])
    check_codec(codec, ["a" * 20_000, "ab'll" * 3000, "1" * 9000, "é" * 9000, "don't they'll WE'RE x's", "²½ªº ß", "á ́b", "<|startoftext|>x<|endoftext|>", "<|endoftext|>" * 900, "K Å ſ", " 　x"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"]), st.sampled_from("'stlred <|>\n")), max_size=60), max_size=4))
def test_codec_on_any_text(texts):
    check_codec(_shared(), texts)


_CODEC = []


def _shared():
    if not _CODEC:
        _CODEC.append(bpe.Codec(tokens.path("word_bpe_49k.json")))
    return _CODEC[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgihrstnol'éß漢字12!?<|>endoftextΣ́"), min_size=1, max_size=900))
def test_tree_equals_whole(text):
    t = _shared().tokenizer
    assert bpe.TreeEncoder(t, leaf=64, window=8).ids(text) == t.encode(text, add_special_tokens=False).ids


def test_codec_rows(spark, codec):
    rows = C.odd_rows()
    got = sorted([tuple(r)[:4] for r in bpe.encode(C.frame(spark, rows)).collect()], key=repr)
    want = [(d, len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(x).hexdigest()) for (d, *_), (i, x) in zip(rows, codec.run([r[1] for r in rows]), strict=True)]
    assert got == sorted(want, key=repr)
    full = bpe.encode(C.frame(spark, rows[:2]), keep_ids=True).collect()
    assert all(r.ids == [] and r.decoded == "" for r in full)
    assert bpe.encode(C.frame(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------- op6


def brute_components(rows):
    def shingles(t):
        w = C.words(C.lower(t or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()

    nodes = defaultdict(list)
    for d, t, *_ in rows:
        nodes[d].append(shingles(t))
    parent = {d: d for d in nodes if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if find(a) != find(b) and any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in nodes[a] for y in nodes[b]):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted([(d, len(shingles(t)), None if d is None else find(d)) for d, t, *_ in rows], key=repr)


def families(seed, sizes=(3, 4, 5, 8, 12, 20, 40, 100, 300)):
    r, texts = random.Random(seed), []
    for _ in range(40):
        base = prose(r, r.choice(sizes)).split()
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // r.choice([10, 20, 40])))):
                i = r.randrange(len(t))
                t[i : i + 1] = r.choice([["new"], [], [t[i], "more"]])
            texts.append(" ".join(t))
    r.shuffle(texts)
    return [(100 + i, t, "en", "a", 1) for i, t in enumerate(texts)]


def test_components_match_brute_force(spark):
    rows = C.odd_rows() + families(7)
    df = C.frame(spark, rows)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(df).collect()], key=repr)
    assert got == brute_components(rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    roots = {c for _, _, c in got if c is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(roots) and kept.where("doc_id IS NULL").count() == 1
    assert jaccard.link_components(df.limit(0)).count() == 0


def test_chains_across_entries_are_found(spark):
    """Texts that each link with the next only, all sharing entries with the first: the second round must find the links."""
    r = random.Random(9)
    words = prose(r, 130, 100_000).split()
    rows = []
    for i in range(12):
        rows.append((500 - i, " ".join(words), "en", "a", 1))
        words[i * 10 + 1] = f"changed{i}"
    got = {x.doc_id: x.component_id for x in jaccard.link_components(C.frame(spark, rows)).collect()}
    assert {(d, c) for d, _, c in brute_components(rows)} == set(got.items())


def test_many_components_in_one_entry(spark, monkeypatch):
    """A passage in every text, own words beside it: few link, all share entries; names that clash are told apart."""
    r = random.Random(21)
    passage = prose(r, 60, 100_000)
    rows = []
    for i in range(60):
        own = prose(r, r.choice([2, 3, 4, 12]), 100_000)
        rows.append((i, f"{own} {passage}", "en", "a", 1))
    rows += [(70, rows[3][1], "en", "a", 1), (70, "other words altogether in this row", "en", "a", 1), (71, "Other words altogether in this row", "en", "a", 1), (70, "", "en", "a", 0), (72, "", "en", "a", 0)]
    df = C.frame(spark, rows)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 10
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.link_components(df).collect()], key=repr) == want
    known = jaccard.nodes(df).where("name IS NOT NULL").select("h1", "name").distinct().collect()
    clash = tuple(x.h1 for x in known[:20])
    told = {x.h1: x.name for x in jaccard.nodes(df, clash).where("name IS NOT NULL").collect()}
    assert len(set(told.values())) == len(known) and all(told[x] != x for x in clash)
    monkeypatch.setattr(jaccard, "_known", lambda docs: (jaccard.nodes(docs, clash), clash))
    assert sorted([(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.link_components(df).collect()], key=repr) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10**6))
def test_similar_sets_share_an_entry(n, seed):
    r = random.Random(seed)
    a = [r.getrandbits(63) for _ in range(n)]
    b = list(a)
    for _ in range(r.randint(0, n)):
        c = list(b)
        if r.random() < 0.5 and len(c) > 1:
            c.pop(r.randrange(len(c)))
        else:
            c.append(r.getrandbits(63))
        if 100 * len(set(a) & set(c)) < 85 * len(set(a) | set(c)):
            break
        b = c
    doc, h = K.doc_sets(np.repeat([0, 1], [len(a), len(b)]), np.array(a + b, np.uint64))
    d, e = jaccard.entries(doc, h, 2)
    assert set(e[d == 0].tolist()) & set(e[d == 1].tolist())
    if set(a) == set(b):
        return
    d, band, need, empty, e = jaccard.fine_entries(doc, h, 2)
    order = {x: r.random() for x in sorted(set(e.tolist()))}
    first = lambda i, k: {x for *_, x in sorted(zip(empty[(d == i) & (band == k)], map(order.get, e[(d == i) & (band == k)].tolist()), e[(d == i) & (band == k)].tolist(), strict=True))[: int(need[band == k][0])]}
    assert any(first(0, k) & first(1, k) for k in set(band[d == 0].tolist()) & set(band[d == 1].tolist()))


# ------------------------------------------------------------------- op7


def test_ngrams_match_brute_force():
    texts = ["Hello, wörld.", "", "a b", "...x", "é!", " \n", "abc..", "Zz"]
    want = Counter()
    for i, t in enumerate(texts):
        for w in bytes(langid._CODE[x] for x in t.encode()).split(b"\0"):
            p = b"\0" + w + b"\0"
            for k in (1, 2, 3):
                for q in (p[j : j + k] for j in range(len(p) - k + 1) if w):
                    if q != b"\0" and not (k == 3 and q[1] == 0):
                        want[i, (k << 24) | int.from_bytes(q, "big")] += 1
    for c in K.chunks(pa.array(texts)):
        o, g, n = langid.grams(c, np.arange(c.n))
        assert Counter({(int(a), int(b)): int(x) for a, b, x in zip(o, g, n, strict=True)}) == want


def test_languages(spark):
    r = random.Random(5)
    say = {"aa": "bana coro delu fimi", "bb": "xyk wqrt zzgh kkpt", "cc": "éàù çôî ëïü"}
    rows = [(i, " ".join(r.choice(say[lang].split()) for _ in range(30)), lang, "a", 1) for i, lang in enumerate(list(say) * 40)] + [(1000 + i, t, None, None, None) for i, t in enumerate([None, "", "123 !", "‐ 。", "дом"])]
    got = {x.doc_id: x for x in langid.identify(C.frame(spark, rows)).collect()}
    for d, t, lang, *_ in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1
        if lang:
            assert got[d].lang_pred == lang
    assert [got[1000 + i].lang_pred == "und" for i in range(5)] == [True, True, True, True, False]
    assert len(langid.identify(C.frame(spark, C.odd_rows())).collect()) == len(C.odd_rows())
    none = langid.identify(C.frame(spark, [(1, "text", None, None, None)])).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)
    assert langid.identify(C.frame(spark, rows).limit(0)).count() == 0


# ------------------------------------------------------------------- op8


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", C.lower(text or ""))
    places, base = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    found = []
    for i in range(len(w)):
        window = " ".join(w[i : i + licenses.WINDOW_WORDS])
        for r in licenses.rules():
            if r.key == w[i] and (m := re.match(f"({r.pattern})(?: |$)", window)):
                found.append((i, -(i + len(m[1].split(" "))), r.priority, r.label, r.weight))
    kept, upto = [], -1
    for s, e, p, label, weight in sorted(found):
        if -e > upto:
            kept.append((label, weight))
            upto = -e
    labels = base | {x for x, _ in kept}
    score = max([x for _, x in kept] + [0.9 if base else 0.0])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_licenses_match_brute_force(spark):
    texts = [
        "Under the MIT license. under the mit license under the mit-license", "CC BY NC cc-by-nc cc by nc sa 4.0", "Licensed under the Apache License, Version 2.0 (the", "SPDX-License-Identifier: GPL-3.0-or-later",
        "Permission is hereby granted, free of charge, to any person obtaining a copy", "GNU Lesser General Public License v2.1; all rights reserved", "released into the public domain under CC0", "license mit mit license bsd 3-clause license",
        "BSD", "nothing here", "apache license version 2apache license version 2", "éunder the mit license", "under the MİT license", "dual licensed under the terms of the mozilla public license 2.0 licence", "Licensed under the Mozilla Public License v2.0", "Eclipse Public License v1.0 license", "under the GPL v3 license", "LGPL v2.1 licensed under lgpl v2.1", "either version 3 of the License, or (at your option) any later version", "https://creativecommons.org/licenses/by-sa/4.0", "cc by", "mit " * 50, "x licence MIT",
    ]
    rows = C.odd_rows() + [(50 + i, t, "en", "a", 1) for i, t in enumerate(texts)]
    got = sorted([tuple(r) for r in licenses.scan(C.frame(spark, rows)).collect()], key=repr)
    assert got == sorted([(d, *brute_licenses(t)) for d, t, *_ in rows], key=repr)
    assert licenses.scan(C.frame(spark, rows).limit(0)).count() == 0 and len(licenses.rules()) > 200


def test_licenses_run_no_python(spark):
    plan = licenses.scan(C.frame(spark, C.odd_rows(), False))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------- op9


def toxic_rows(n=400):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        t = ["".join(r.choice(["ka", "lo", "mi", "nu", "re", "ti"]) for _ in range(r.randint(2, 4))) for _ in range(60)]
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(["vilething", "grotbag", "numbskull", "Numbskulls"]))
        rows.append((i, " ".join(t), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    extra = [(5000 + d if d is not None else None, *x) for d, *x in C.odd_rows()]
    docs, marks = C.frame(spark, rows + extra), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, marks).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    truth = {i: t for i, _, t in labels}
    held = [x for x in got if x.doc_id in truth and x.held_out]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    right = sum(x.predicted == truth[x.doc_id] for x in held)
    assert right >= 0.95 * len(held)
    model = toxicity.fit(docs, marks)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not x.predicted for x in got)


def test_dictionaries_are_trained_and_length_does_not_dilute():
    rows, labels = toxic_rows(1200)
    truth = {i: t for i, _, t in labels}
    model = toxicity.train([t for i, t, *_ in rows if truth[i]], [t for i, t, *_ in rows if not truth[i]])
    magic = bytes.fromhex("37a430ec")  # of dictionaries that zstandard trained
    assert model.ordinary[:4] == model.toxic[:4] == magic and model.ordinary != model.toxic
    scorer = toxicity.Scorer(model)
    clean = " ".join(t for i, t, *_ in rows[:600] if not truth[i])
    bad = "vilething ka grotbag lo numbskull mi vilething nu grotbag re numbskull"
    assert scorer.score(clean) < 0.7 <= scorer.score(bad) <= scorer.score(f"{clean} {bad} {clean}")


def test_toxicity_with_nothing_to_learn(spark):
    docs = C.frame(spark, C.odd_rows())
    none = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(none) == len(C.odd_rows()) and all(x.score == 0 for x in none)
    rows, labels = toxic_rows(40)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.classify(C.frame(spark, rows).limit(0), marks).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = toxic_rows(120)
    docs = C.frame(spark, rows)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert toxicity.fit(docs, frame(labels)) == toxicity.fit(docs, frame(turned))


# ------------------------------------------------------------------ op10


def check_shards(rows, got, even):
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
    for rs in by.values():
        assert sorted(x.slot for x in rs) == list(range(len(rs)))
    assert sorted([(x.doc_id, x.size, x.text_crc32) for x in got], key=repr) == sorted([(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows], key=repr)
    if even:
        sizes = [sum(x.size for x in by[s]) for s in range(16)]
        assert max(sizes) <= 1.15 * min(sizes)


def test_shards(spark):
    r = random.Random(8)
    rows = [(i, prose(r, r.randint(5, 60)), r.choice(["en", "de"]), "hot" if i % 3 else f"s{i % 7}", 1) for i in range(3000)]
    rows += [(5000 + i, prose(random.Random(i // 5), 30), "en", "hot", 1) for i in range(300)]
    got = sharding.shard(C.frame(spark, rows)).collect()
    check_shards(rows, got, True)
    of = defaultdict(set)
    for x in got:
        of[x.text_crc32, x.size].add(x.shard)
    assert all(len(s) == 1 for s in of.values())


def test_a_group_larger_than_a_shard_is_taken_apart(spark):
    r = random.Random(9)
    rows = [(i, "copy " * 10 if i % 2 else prose(r, 10), None, None, None) for i in range(4000)]
    check_shards(rows, sharding.shard(C.frame(spark, rows)).collect(), True)


@pytest.mark.parametrize("share", [0.5, 0.7, 0.95])
def test_a_group_of_up_to_a_shard_leaves_sizes_even(spark, share):
    r = random.Random(10)
    rows = [(i, prose(r, 10), None, None, None) for i in range(4000)]
    size = sum(len(t) + 1 for _, t, *_ in rows) / 16
    # the least doc_id puts the group on a median
    rows += [(2000 if not i else 10000 + i, "copy " * 10, None, None, None) for i in range(int(share * size / 51))]
    check_shards(rows, sharding.shard(spark.createDataFrame(rows, C.SCHEMA).repartition(3)).collect(), True)


def test_odd_rows_in_shards(spark):
    check_shards(C.odd_rows(), sharding.shard(C.frame(spark, C.odd_rows())).collect(), False)
    assert sharding.shard(C.frame(spark, C.odd_rows()).limit(0)).count() == 0


# ------------------------------------------------------------- queries


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op2_quality_rules", "op3_decontamination", "op6_jaccard_join", "op8_license_scan"])
def test_sql_gives_the_same(spark, name):
    import duckdb

    from timberline.llm import queries

    from ..test_entry import rows_of

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())
