"""Quality rules with adaptive thresholds.

Each document gets integer rule values.  Their distributions are summarised per
(lang, source) as quantile sketches: counts in buckets whose width grows with
the value, so that two sketches merge by adding counts and a quantile is exact
to about 3 %.  Sketches merge upwards, from (lang, source) to lang to everything.
A rule's fence lies as far from the median as a quartile's outer fence would for
a normal distribution; its scale is taken from the innermost quantile that is
not the median itself, as three quarters of all documents may have no symbols at
all.  A group's threshold is the mean of its own fence and that of the group
above it, weighted by its documents and by PRIOR.  No fixed cutoff takes part.
A sketch does not tell quantiles closer than 1/32 of their value, so a quartile
counts as at least that far from the median.  One case is degenerate: where 98 of
100 documents have no symbols (or the like), the fence is 0.  The thresholds are joined back to filter the documents.

Contract (op2): words are [^\\x20\\x09-\\x0D]+ of every whole text; n_words,
word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept as the
contract has them; kept is false for base_failed, else the verdict of the rules.

Edge cases: null or empty text has no words, all counts 0, base_failed true; null
lang or source is a group of its own; an empty table gives an empty result and
no thresholds; ties fall in one bucket; repeated rows count each time; other
columns are ignored, whatever their names; a very long text is measured whole, in
some 100 bytes of memory a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: The symbols counted.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents that the group above counts as in a group's threshold; salts of the join's hot keys.
PRIOR, SALTS = 30, 16
#: Quantiles (per thousand) on either side of the median, from the inside, and what a distance from the median is multiplied by: 4.72, where a normal distribution has its outer fence, over the quantile's own.
QUANTILES = ((250, "7.0e0"), (100, "3.68e0"), (50, "2.87e0"), (10, "2.03e0"))

#: Rules: name, value per thousand (or per hundred words), side.
RULES = (
    ("symbols", "n_symbols * 1000 div greatest(word_chars, 1)", "upper"),
    ("dup_lines", "n_dup_lines * 1000 div greatest(n_lines, 1)", "upper"),
    ("repeats", "n_repeat_words * 1000 div greatest(n_words, 1)", "upper"),
    ("long_words", "word_chars * 100 div greatest(n_words, 1)", "upper"),
    ("short_words", "word_chars * 100 div greatest(n_words, 1)", "lower"),
)
_PARTS = sorted([500, *(q for q, _ in QUANTILES), *(1000 - q for q, _ in QUANTILES)])
_LEAST = f"{QUANTILES[0][1]} * p500 / 32e0"
_UPPER_FENCE = "p500 + greatest(CASE " + " ".join(f"WHEN p{1000 - q} > p500 THEN {a} * (p{1000 - q} - p500)" for q, a in QUANTILES) + f" ELSE 0e0 END, {_LEAST})"
_LOWER_FENCE = "p500 - greatest(CASE " + " ".join(f"WHEN p{q} < p500 THEN {a} * (p500 - p{q})" for q, a in QUANTILES) + f" ELSE 0e0 END, {_LEAST})"
#: The fence of a rule from its quantiles, in SQL that both engines read.
_FENCE = f"CASE WHEN rule IN ({', '.join(repr(name) for name, _, side in RULES if side == 'lower')}) THEN {_LOWER_FENCE} ELSE {_UPPER_FENCE} END"


def _shrunk(docs: str, own: str, above: str) -> str:
    return f"({docs} * {own} + {PRIOR} * {above}) / ({docs} + {PRIOR})"


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SCHEMA = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _per_doc(flags_at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the sorted positions fall in each document."""
    return np.diff(np.searchsorted(flags_at, off))


def measures(chunk: K.Chunk) -> dict[str, np.ndarray]:
    data, off, n = chunk.data, chunk.off, chunk.n
    words = K.Words(chunk)
    prefix = K.prefix_hash(data)
    n_words = np.diff(words.at)
    # code points in words: bytes that don't continue one
    lead = (data & 0xC0) != 0x80
    lead_sum = np.concatenate([[0], np.cumsum(lead)])
    in_word = lead_sum[words.end] - lead_sum[words.start]
    word_chars = np.bincount(words.doc, in_word, n).astype(np.int64) if len(in_word) else np.zeros(n, np.int64)
    symbols = _per_doc(np.flatnonzero(_SYMBOL[data]), off)
    # lines with a word that equal an earlier line of the document
    # a line ends before its \n, or where its document does; one that starts at a document's start has no \n before it
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, off[:-1]]))
    start = cut[cut < len(data)]
    nxt = np.minimum(np.append(start[1:], len(data)), off[np.searchsorted(off, start, "right")])
    end = np.where((nxt > start) & (data[nxt - 1] == 10), nxt - 1, nxt) if len(start) else nxt
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has_word], end[has_word]
    line_doc = np.searchsorted(off, start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=n)
    key = K.mix(K.span_hash(prefix, start, end) + line_doc.astype(np.uint64) * K.U(0x9E3779B97F4A7C15))
    distinct = np.unique(key, return_index=True)[1]
    dup_lines = n_lines - np.bincount(line_doc[distinct], minlength=n)
    # words in a 3-word window that is found twice or more
    wh = K.span_hash(prefix, words.start, words.end)
    repeat = np.zeros(len(wh), bool)
    if len(wh) >= 3:
        win = np.flatnonzero(np.arange(len(wh)) + 3 <= words.at[1:][words.doc])
        key = K.mix(K.shingle_hashes(wh, 3)[win] + words.doc[win].astype(np.uint64) * K.U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        at = K.runs(key[order])
        twice = np.repeat(np.diff(np.append(at, len(key))) > 1, np.diff(np.append(at, len(key))))
        for j in range(3):
            repeat[win[order[twice]] + j] = True
    n_repeat = np.bincount(words.doc[repeat], minlength=n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat, "n_lines": n_lines}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b.column(3)):
                m = measures(c)
                part = b.slice(c.first, c.n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(v.astype(np.int64)) for v in m.values())], ["doc_id", "lang", "source", *m])

    return K.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, _SCHEMA)


def bucket(value: Column) -> Column:
    """Bucket of a value of 0 or more: itself below 64; above, its five leading bits and its number of bits."""
    bits = F.length(F.bin(value))
    return F.when(value < 64, value).otherwise((bits - 6) * 32 + F.floor(value / F.pow(F.lit(2.0), bits - 6)).cast("long"))


def bucket_top(b: Column) -> Column:
    """The largest value in a bucket."""
    e = F.floor((b - 32) / 32).cast("int")
    return F.when(b < 64, b).otherwise(((b - e * 32 + 1) * F.pow(F.lit(2.0), e)).cast("long") - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: one mergeable sketch for each group and rule."""
    values = F.array(*(F.struct(F.lit(name).alias("rule"), F.expr(value).cast("long").alias("value")) for name, value, _ in RULES))
    return rows.select("lang", "source", F.explode(values).alias("v")).select("lang", "source", "v.rule", bucket(F.col("v.value")).alias("bucket")).groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, rule, docs and fence after merging all sketches of each group."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    counts = merged.groupBy(*by, "rule").agg(F.sum("n").alias("docs"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("cells"))
    # buckets of a sketch are at most some 2,000, whatever the number of documents
    upto = F.expr("transform(sequence(1, size(cells)), i -> struct(cells[i - 1].bucket as bucket, aggregate(slice(cells, 1, i), 0L, (s, c) -> s + c.n) as upto))")
    quantile = lambda part: bucket_top(F.expr(f"filter(upto, c -> c.upto * 1000 >= docs * {part})[0].bucket")).cast("double").alias(f"p{part}")
    return counts.withColumn("upto", upto).select(*by, "rule", "docs", *(quantile(p) for p in _PARTS)).select(*by, "rule", F.col("docs").cast("double").alias("docs"), F.expr(_FENCE).alias("fence"))


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source and for each rule its threshold, drawn towards those of the groups above."""
    sketch = sketches(rows)
    own, lang, everything = fences(sketch, ["lang", "source"]), fences(sketch, ["lang"]), fences(sketch, [])
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("rule").alias("l_rule"), F.col("docs").alias("l_docs"), F.col("fence").alias("l_fence"))
    everything = everything.select(F.col("rule").alias("g_rule"), F.col("fence").alias("g_fence"))
    # one row a rule is broadcast
    joined = own.join(lang, (F.col("lang").eqNullSafe(F.col("l_lang"))) & (F.col("rule") == F.col("l_rule"))).join(F.broadcast(everything), F.col("rule") == F.col("g_rule"))
    chosen = joined.withColumn("above", F.expr(_shrunk("l_docs", "l_fence", "g_fence"))).withColumn("at", F.expr(_shrunk("docs", "fence", "above")))
    return chosen.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == name, F.col("at"))).alias(f"at_{name}") for name, _, _ in RULES))


def judge(docs: DataFrame) -> DataFrame:
    """Every row with its counts, base_failed, the rules it fails, and kept."""
    rows = K.written(measured(docs), "quality")
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    at = thresholds(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.col("salt").alias("t_salt"), *(f"at_{r[0]}" for r in RULES))
    joined = rows.withColumn("salt", salt).join(at, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("salt") == F.col("t_salt")), "left")
    failed = F.array_compact(F.array(*(F.when(F.expr(value) > F.col(f"at_{name}") if side == "upper" else F.expr(value) < F.col(f"at_{name}"), F.lit(name)) for name, value, side in RULES)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("rules_failed"))


#: The same in DuckDB's SQL. Sketch buckets are integers, so quantiles are the same to the last digit.
ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE [] END AS g,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM base
), numbered AS (SELECT row_number() OVER () AS rid, * FROM grams
), spread AS (SELECT rid, unnest(g) AS gram, unnest(range(0, len(g))) AS p FROM numbered WHERE len(g) > 1
), twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS c FROM spread) WHERE c > 1
), rep AS (SELECT rid, count(DISTINCT p + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid
), rows AS (
  SELECT doc_id, lang, source, rid, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines FROM numbered LEFT JOIN rep USING (rid)
), v AS (
  SELECT rid, lang, source, unnest([{", ".join("{'rule': '" + name + "', 'value': (" + value.replace(" div ", " // ") + ")}" for name, value, _ in RULES)}]) AS s FROM rows
), b AS (
  SELECT lang, source, s.rule AS rule, CASE WHEN s.value < 64 THEN s.value ELSE (length(bin(s.value)) - 6) * 32 + s.value // CAST(pow(2, length(bin(s.value)) - 6) AS BIGINT) END AS bucket, count(*) AS n FROM v GROUP BY ALL
), levels AS (
  SELECT 0 AS lvl, lang, source, rule, bucket, n FROM b UNION ALL SELECT 1, lang, NULL, rule, bucket, sum(n) FROM b GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, rule, bucket, sum(n) FROM b GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, rule) AS docs FROM levels
), q AS (
  SELECT lvl, lang, source, rule, docs, {", ".join(f"min(bucket) FILTER (upto * 1000 >= docs * {p}) AS b{p}" for p in _PARTS)} FROM c GROUP BY ALL
), qv AS (
  SELECT lvl, lang, source, rule, CAST(docs AS DOUBLE) AS docs, {", ".join(f"CAST(CASE WHEN b{p} < 64 THEN b{p} ELSE (b{p} - (b{p} - 32) // 32 * 32 + 1) * CAST(pow(2, (b{p} - 32) // 32) AS BIGINT) - 1 END AS DOUBLE) AS p{p}" for p in _PARTS)} FROM q
), qf AS (SELECT lvl, lang, source, rule, docs, {_FENCE} AS fence FROM qv
), above AS (
  SELECT l.lang, l.rule, {_shrunk("l.docs", "l.fence", "g.fence")} AS above FROM qf l JOIN qf g ON g.lvl = 2 AND g.rule = l.rule WHERE l.lvl = 1
), chosen AS (
  SELECT o.lang, o.source, o.rule, {_shrunk("o.docs", "o.fence", "above")} AS bound FROM qf o JOIN above a ON a.lang IS NOT DISTINCT FROM o.lang AND a.rule = o.rule WHERE o.lvl = 0
), fence AS (
  SELECT lang, source, {", ".join(f"max(CASE WHEN rule = '{name}' THEN bound END) AS at_{name}" for name, _, _ in RULES)} FROM chosen GROUP BY ALL
), f AS (
  SELECT rows.*, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
    concat_ws(',', {", ".join(f"CASE WHEN ({value.replace(' div ', ' // ')}) {'>' if side == 'upper' else '<'} at_{name} THEN '{name}' END" for name, value, side in RULES)}) AS rules_failed
  FROM rows LEFT JOIN fence ON fence.lang IS NOT DISTINCT FROM rows.lang AND fence.source IS NOT DISTINCT FROM rows.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules_failed = '' AS kept, rules_failed FROM f
"""
