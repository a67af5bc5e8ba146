"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams, best first.  A
document's own list is compared with each profile: every n-gram counts the number
of places it is out of place, or the longest possible if the profile lacks it,
and the language with the least total wins.

n-grams are of 1 to 3 UTF-8 bytes of words (letters a-z after lower-casing A-Z,
and non-ASCII bytes), with a mark at a word's start and end.  They are counted
over all learning rows; what is collected is PROFILE n-grams for each language.

Contract (op7): learns from text and non-null lang of rows whose crc32(doc_id as
text) mod 3 is not 1; nothing else of a row enters a prediction.

Edge cases: a text that is null, empty or without a letter is `und` with score 0,
as are all texts if nothing can be learnt; n-grams of the same count are ranked
by their bytes, languages of the same distance by name; a null doc_id is not held
out and is not learnt from; repeated rows count each time; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .toxicity import is_held_out

PROFILE = 300
SCHEMA = "doc_id long, lang_pred string, score double"

U = K.U
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def grams(c: K.Chunk, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of the chunk, sorted by owner and n-gram; owner is a number below 2**30 for each document, or negative to leave it out."""
    code = _CODE[c.data]
    # a mark before each document, so that words never join across documents
    at = c.off[:-1]
    code = np.insert(code, at, 0)
    doc = np.repeat(np.arange(c.n), np.diff(c.off) + 1)
    keep = code != 0  # of marks in a row the last stays: it is the next word's own
    keep[:-1] |= keep[1:]
    code, who = code[keep].astype(np.uint64), owner[doc[keep]]
    if len(code):
        code, who = np.append(code, U(0)), np.append(who, who[-1])
    a, b, d = code[:-2], code[1:-1], code[2:]
    same2, same3 = who[:-1] == who[1:], who[:-2] == who[2:]
    one = np.flatnonzero((code != 0) & (who >= 0))
    two = np.flatnonzero((code[:-1] | code[1:] != 0) & (who[:-1] >= 0) & (same2 | (code[1:] == 0)))
    three = np.flatnonzero((b != 0) & (who[:-2] >= 0) & (same3 | (d == 0)))
    key = np.concatenate([
        (who[one].astype(np.uint64) << U(26)) | (U(1) << U(24)) | code[one],
        (who[two].astype(np.uint64) << U(26)) | (U(2) << U(24)) | (code[two] << U(8)) | code[two + 1],
        (who[three].astype(np.uint64) << U(26)) | (U(3) << U(24)) | (a[three] << U(16)) | (b[three] << U(8)) | d[three],
    ])
    key.sort()
    starts = K.runs(key)
    key, count = key[starts], np.diff(np.append(starts, len(key)))
    return (key >> U(26)).astype(np.int64), (key & U((1 << 26) - 1)).astype(np.int64), count


def _best(owner: np.ndarray, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank from 0) of each owner's PROFILE most frequent n-grams."""
    key = (owner.astype(np.uint64) << U(34)) | (U((1 << 34) - 1) - np.minimum(count, (1 << 34) - 1).astype(np.uint64))
    order = np.argsort(key, kind="stable")  # n-grams ascend within an owner already
    owner, gram = owner[order], gram[order]
    starts = K.runs(owner)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    keep = rank < PROFILE
    return owner[keep], gram[keep], rank[keep]


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """The profile of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.concatenate([total[0], *(k for k, _ in held)]), np.concatenate([total[1], *(n for _, n in held)])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            starts = K.runs(key)
            return key[starts], np.add.reduceat(n, starts) if len(starts) else n

        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int64)
            for c in K.chunks(batch.column(1)):
                owner, gram, n = grams(c, lang[c.first : c.first + c.n])
                held.append(((owner.astype(np.uint64) << U(26)) | gram.astype(np.uint64), n))
                if len(held) >= 16:
                    total, held = merged(), []
        key, n = merged()
        by_number = np.array(list(names), object)
        for i in range(0, len(key), 50_000):
            k = key[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(by_number[(k >> U(26)).astype(np.int64)], pa.string()), pa.array((k & U((1 << 26) - 1)).astype(np.int64)), pa.array(n[i : i + 50_000])], ["lang", "gram", "n"])

    rows = K.bounded(docs).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id")).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    out: dict[str, list[int]] = {}
    # PROFILE numbers a language, whatever the number of documents
    for r in best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams")).toLocalIterator():
        out[r.lang] = [g.gram for g in r.grams]
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.tables = []
        for name in self.names:
            gram = np.array(profiles[name], np.int64)
            order = np.argsort(gram)
            self.tables.append((gram[order], order))

    def predict(self, c: K.Chunk) -> tuple[list[str], np.ndarray]:
        letter = _CODE[c.data] != 0
        lettered = np.diff(np.concatenate([[0], np.cumsum(letter)])[c.off]) > 0
        ascii_letter = letter & (c.data < 128)
        doubtful = lettered & (np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[c.off]) == 0)
        for i in np.flatnonzero(doubtful).tolist():
            lettered[i] = any(x.isalpha() for x in c.data[c.off[i] : c.off[i + 1]].tobytes().decode("utf-8", "replace"))
        if not self.names:
            return ["und"] * c.n, np.zeros(c.n)
        owner, gram, rank = _best(*grams(c, np.where(lettered, np.arange(c.n), -1)))
        distance = np.empty((len(self.names), c.n))
        for i, (known, place) in enumerate(self.tables):
            j = np.minimum(np.searchsorted(known, gram), len(known) - 1)
            off = np.where(known[j] == gram, np.abs(place[j] - rank), PROFILE)
            distance[i] = np.bincount(owner, off, c.n)
        best = distance.argmin(axis=0)
        first = distance[best, np.arange(c.n)]
        if len(self.names) > 1:
            second = np.partition(distance, 1, axis=0)[1]
        else:
            second = np.bincount(owner, minlength=c.n) * float(PROFILE)
        score = np.where(lettered & (second > 0), (second - first) / np.maximum(second, 1), 0.0)
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                names, score = model.predict(c)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, c.n), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return K.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs)).select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score")
