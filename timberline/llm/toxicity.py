"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one
on passages of toxic text.  A window is compressed with the ordinary dictionary
alone and with the toxic one put before it: the bytes that this saves are the
window's closeness to toxic text.  (Lengths under two dictionaries that share
nothing differ more by what happens to be in them than by toxicity.)  Windows
overlap by half; those that save at least a threshold give evidence, which is
added up over stretches of windows, and the best stretch of a text counts, so
that length does not dilute a passage.

Toxic texts are ordinary for the most part.  Their passages are found by
compression, too: the windows that the toxic dictionary of the other half of the
training texts saves most on, and of these the shortest pieces that it does so
on, are what the next dictionary is trained on, for some rounds.  The threshold,
and the score that an amount of evidence stands for, are calibrated on savings
under dictionaries that the text had no part in.

Contract (op9): scores whole texts of every document.  Only rows with a non-null
label and crc32(doc_id as text) mod 3 other than 1 are learnt from; labels,
lang, source and doc_id are no inputs of a score.

Edge cases: null or empty text scores as a text without evidence; a null doc_id
is not held out and is never learnt from; repeated doc_ids each get a row, and a
doc_id that is labelled both ways counts as toxic; with no toxic or no ordinary
training row every score is 0; an empty table gives an empty result; a very long
text is cut into as many windows as it has, of which 2 bytes each are held;
other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Bounds of the training sample: rows of each label, and bytes of one row.
TRAIN_TOXIC_ROWS, TRAIN_ORDINARY_ROWS, TRAIN_ROW_BYTES = 1_500, 3_000, 20_000
WINDOW_BYTES, STRETCH = 96, 24
LEVEL = 12
ORDINARY_DICT_BYTES, TOXIC_DICT_BYTES = 112_640, 8_192
#: Of the trainer: bytes of a segment, and of what is counted in it.
SEGMENT, COUNTED = 32, 6
#: Rounds on whole windows and then on pieces of PIECE_BYTES; the share of ordinary windows that saves more than a passage must; the least passages of a round.
ROUNDS, PIECE_ROUNDS, PIECE_BYTES, ORDINARY_SHARE, LEAST_PASSAGES = 3, 2, 12, 0.01, 20
#: Training texts that share more of their five-word runs with ones before are copies: left out, for they would be found by heart.
COPY = 0.2
PREDICT_AT = 0.7

_SCHEMA = "doc_id long, score double"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    saved_at: int
    #: Upper bound of evidence, and the score up to it; ascending.
    steps: tuple[tuple[float, float], ...]


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _distinct(texts: list[bytes]) -> list[bytes]:
    seen, out = set(), []
    for t in texts:
        words = t.split()
        runs = {hash(tuple(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        if len(runs & seen) <= COPY * len(runs):
            out.append(t)
        seen |= runs
    return out


def _dictionary(samples: list[bytes], most: int) -> bytes:
    """What zstandard trains from the samples; the samples themselves where they are too few to train on."""
    size = max(512, min(most, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=COUNTED, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-most:] or b" "


def windows(text: bytes) -> list[bytes]:
    """The whole text in pieces of about WINDOW_BYTES that end at a space where there is one."""
    out, i, n = [], 0, len(text)
    while n - i > WINDOW_BYTES:
        j = text.rfind(b" ", i + WINDOW_BYTES // 2, i + WINDOW_BYTES)
        j = j if j > 0 else i + WINDOW_BYTES
        out.append(text[i:j])
        i = j
    out.append(text[i:])
    return out


def _lengths(content: bytes):
    """Compressed lengths of windows under a dictionary."""
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW_BYTES, dict_size=len(content), write_content_size=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress
    return lambda parts: np.fromiter((len(compress(w)) for w in parts), np.int16, len(parts))


def _cut(raw: bytes) -> list[bytes]:
    """Windows of the whole text, every place in two, which are cut half a window apart."""
    half = WINDOW_BYTES // 2
    return [*windows(raw), *(windows(raw[half:]) if len(raw) > half else ())]


def evidence(saved: np.ndarray, at: int) -> float:
    """The most bytes that a stretch of windows saves beyond the threshold; the two cuts of a text are stretches of their own."""
    over = np.maximum(saved.astype(np.int64) - at + 1, 0)
    total = np.concatenate([[0], np.cumsum(over)])
    return float((total[STRETCH:] - total[:-STRETCH]).max()) if len(saved) > STRETCH else float(total[-1])


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.plain, self.marked = _lengths(model.ordinary), _lengths(model.toxic + model.ordinary)

    def saved(self, text: str) -> np.ndarray:
        parts = _cut(b" " + text.lower().encode("utf-8", "surrogatepass"))
        return self.plain(parts) - self.marked(parts)

    def score(self, text: str | None) -> float:
        e = evidence(self.saved(text or ""), self.model.saved_at)
        for bound, p in self.model.steps:
            if e <= bound:
                return p
        return self.model.steps[-1][1]


_BOUNDS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 14.0, 20.0, math.inf)


def _piece(window: bytes, plain, marked) -> bytes:
    """The run of words, PIECE_BYTES long or the word that takes it beyond, that the toxic dictionary saves most on."""
    words, runs = window.split(b" "), []
    for i in range(len(words)):
        j, run = i + 1, b" " + words[i] + b" "
        while len(run) < PIECE_BYTES and j < len(words):
            run, j = run + words[j] + b" ", j + 1
        runs.append(run)
    return runs[int(np.argmax(plain(runs) - marked(runs)))]


def train(toxic: list[str], ordinary: list[str], share: float | None = None) -> Model:
    """share: of toxic rows among all that are labelled; that of the texts given where it is not."""
    raw = lambda texts: _distinct([b" " + t.lower().encode("utf-8", "surrogatepass") for t in texts])
    toxic, ordinary = raw(toxic), raw(ordinary)
    if not toxic or not ordinary:
        return Model(b" ", b" ", 1 << 30, ((math.inf, 0.0),))
    cut_t, cut_o = [windows(t) for t in toxic], [windows(t) for t in ordinary]
    halves = (0, 1)
    # the dictionaries of a half come from the texts of the other one
    plain_dict = [_dictionary([w for t in cut_o[1 - h :: 2] for w in t] or [b" "], ORDINARY_DICT_BYTES) for h in halves]
    plain = [_lengths(d) for d in plain_dict]
    of_windows = lambda texts, measure: [measure[i % 2](t) for i, t in enumerate(texts)]
    plain_t, plain_o = of_windows(cut_t, plain), of_windows(cut_o, plain)
    passages = [[w for t in cut_t[h::2] for w in t] for h in halves]
    for left in reversed(range(ROUNDS + PIECE_ROUNDS + 1)):
        toxic_dict = [_dictionary(passages[1 - h] or [b" "], TOXIC_DICT_BYTES) for h in halves]
        marked = [_lengths(toxic_dict[h] + plain_dict[h]) for h in halves]
        if not left:
            break
        saved_t = [a - b for a, b in zip(plain_t, of_windows(cut_t, marked), strict=True)]
        saved_o = np.concatenate([a - b for a, b in zip(plain_o, of_windows(cut_o, marked), strict=True)])
        at = min(np.quantile(saved_o, 1 - ORDINARY_SHARE), np.sort(np.concatenate(saved_t))[-LEAST_PASSAGES:][0] - 1)
        chosen = [[(i % 2, w) for w, x in zip(t, saved_t[i], strict=True) if x > at] for i, t in enumerate(cut_t)]
        passages = [[_piece(w, plain[h], marked[h]) if left <= PIECE_ROUNDS else w for t in chosen[h::2] for _, w in t] for h in halves]
    found = lambda texts: [plain[i % 2](p := _cut(t)) - marked[i % 2](p) for i, t in enumerate(texts)]
    saved_t, saved_o, best = found(toxic), found(ordinary), None
    # rows that a text of either sample stands for
    share = len(toxic) / (len(toxic) + len(ordinary)) if share is None else share
    w_t, w_o = share * (len(toxic) + len(ordinary)) / len(toxic), (1 - share) * (len(toxic) + len(ordinary)) / len(ordinary)
    for at in range(1, 9):
        e_t, e_o = [evidence(s, at) for s in saved_t], [evidence(s, at) for s in saved_o]
        steps, last, loss = [], 0.0, 0.0
        for lo, hi in zip((-1.0, *_BOUNDS), _BOUNDS, strict=False):
            a, b = w_t * sum(lo < e <= hi for e in e_t), w_o * sum(lo < e <= hi for e in e_o)
            p = (a + 0.2) / (a + b + 1) if a + b else last  # shrunk towards ordinary
            last = max(last, p)
            loss -= a * math.log(last) + b * math.log(1 - last) if a + b else 0
            steps.append((hi, round(last, 6)))
        if best is None or loss < best[0]:
            best = loss, at, tuple(steps)
    whole = _dictionary([w for t in cut_o for w in t], ORDINARY_DICT_BYTES)
    return Model(whole, _dictionary([p for h in halves for p in passages[h]] or [b" "], TOXIC_DICT_BYTES), *best[1:])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """From a sample bounded by TRAIN_*: of the labelled doc_ids, the first of each label in the order of a hash."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where(F.col("_toxic").isNotNull() & F.col("_id").isNotNull() & ~is_held_out("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    take = lambda label, n: named.where(F.col("_toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = take(1, TRAIN_TOXIC_ROWS).unionByName(take(0, TRAIN_ORDINARY_ROWS))
    # no more than TRAIN_TOXIC_ROWS + TRAIN_ORDINARY_ROWS pairs of numbers are broadcast
    count = {r._toxic: r["count"] for r in named.groupBy("_toxic").count().collect()}
    usable = docs.select("doc_id", "text").where((F.octet_length("text") <= TRAIN_ROW_BYTES) & (F.octet_length("text") > 0))
    rows = sorted((r._toxic, r.text) for r in usable.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_toxic", "text").distinct().collect())
    return train([t for label, t in rows if label == 1], [t for label, t in rows if label == 0], count.get(1, 0) / max(1, count.get(0, 0) + count.get(1, 0)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row; partitions stream through, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scorer.score(t.as_py()) for t in texts], pa.float64())], ["doc_id", "score"])

    return K.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= PREDICT_AT, 1).otherwise(0).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of the documents that score below PREDICT_AT."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            yield b.filter(pa.array([scorer.score(t.as_py()) < PREDICT_AT for t in b.column(at)], pa.bool_()))

    return K.bounded(docs).mapInArrow(run, docs.schema)
