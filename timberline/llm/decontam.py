"""Benchmark decontamination by SimHash windows, multi-index Hamming search and exact verification.

For each benchmark item, windows of a document as long as the item (in words)
are fingerprinted by SimHash over their 5-word shingles.  A fingerprint is cut
into blocks; two that differ in at most RADIUS bits differ in at most
RADIUS / BLOCKS bits of some block, so an index of each block's neighbourhood
finds all items within the radius.  Those are verified by the exact weighted
Jaccard similarity of shingle counts.  A window of which too few shingles stand in
any item cannot reach the similarity, and is not fingerprinted.

Items are searched in blocks of at most ITEMS_AT_ONCE, so that what is sent to
each worker is bounded, and every document is searched against all of them.

Words are runs of ASCII letters and digits and of non-ASCII characters,
lower-cased in A-Z.  Items with fewer than 5 words are one shingle, matched as a
whole; items without words match nothing.

Edge cases: null or empty texts match nothing; repeated doc_ids give one row for
each item; of windows with the same similarity the first is reported; a null
doc_id or item_id is reported as null; a very long text or item is searched
whole, in 256 bytes of memory a word of the item; other columns are ignored, whatever their
names; empty tables give an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 4, 19
ITEMS_AT_ONCE, BYTES_AT_ONCE = 1000, 8 << 20
#: Words over which windows are fingerprinted at a time: 256 bytes each, and as many for the words of one item.
STRETCH = 4096
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"

U = K.U
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_WIDTH = BITS // BLOCKS
_MASKS = np.array([sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(_WIDTH), r)], np.uint64)
_SHIFTS = np.arange(BITS, dtype=np.uint64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] >> _SHIFTS) & U(1)).astype(np.int16) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


class Index:
    """Items with the same shingle length k: fingerprints, their blocks' neighbourhoods, and shingle counts."""

    def __init__(self, items: list[tuple[int | None, str]], k: int):
        self.k, self.ids, self.sizes, self.counts, prints, every = k, [], [], [], [], []
        for item, text in items:
            raw = text.encode("utf-8")
            c = K.Chunk(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0)
            words = K.Words(c, _WORD)
            n = len(words.start)
            if n == 0 or min(n, SHINGLE) != k:
                continue
            s = K.shingle_hashes(K.word_hashes(c, words), k)[: n - k + 1]
            self.ids.append(item)
            self.sizes.append(n)
            self.counts.append(Counter(s.tolist()))
            prints.append(_fingerprint(_signs(s).sum(axis=0, dtype=np.int32)[None, :])[0])
            every.append(s)
        self.prints = np.array(prints, np.uint64)
        self.size = np.array(self.sizes, np.int64)
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingles & U((1 << 20) - 1)).astype(np.int64)] = True
        self.blocks = []
        for b in range(BLOCKS):
            value = (self.prints >> U(b * _WIDTH)) & U((1 << _WIDTH) - 1)
            near = (value[:, None] ^ _MASKS[None, :]).ravel().astype(np.int64)
            item = np.repeat(np.arange(len(value)), len(_MASKS))
            order = np.argsort(near, kind="stable")
            self.blocks.append((item[order].astype(np.int32), np.searchsorted(near[order], np.arange((1 << _WIDTH) + 1))))

    def near(self, prints: np.ndarray) -> list[np.ndarray]:
        """For each fingerprint, all items within the radius."""
        out = []
        for p in prints:
            found = [items[cuts[v] : cuts[v + 1]] for b, (items, cuts) in enumerate(self.blocks) for v in ((int(p) >> (b * _WIDTH)) & ((1 << _WIDTH) - 1),)]
            found = np.unique(np.concatenate(found))
            out.append(found[np.bitwise_count(self.prints[found] ^ p) <= RADIUS])
        return out

    def search(self, c: K.Chunk, words: K.Words, word_hash: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        """(document, item, similarity, first word) of every window similar enough to an item of its size."""
        k, n = self.k, len(word_hash)
        if not len(self.shingles) or n < k:
            return
        s = K.shingle_hashes(word_hash, k)
        hit = self.maybe[(s & U((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = self.shingles[np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)] == s[at]
        upto = np.concatenate([[0], np.cumsum(hit)])
        # both sides have M shingles, so similarity 0.8 takes 2 M * 0.8 / 1.8 in common
        least = lambda m: math.ceil((m - k + 1) * 2 * SIMILARITY / (1 + SIMILARITY) - 1e-9)
        sizes = np.unique(self.size)
        longest, shortest = int(sizes[-1]), least(int(sizes[0]))
        active = np.flatnonzero(upto[np.minimum(np.arange(n) + longest - k + 1, n)] - upto[:n] >= shortest)
        if not len(active):
            return
        ends = words.at[1:][words.doc[active]]
        for m in sizes.tolist():
            fits = active[active + m <= ends]
            start = fits[upto[fits + m - k + 1] - upto[fits] >= least(m)]
            same = set(np.flatnonzero(self.size == m).tolist())
            i = 0
            while i < len(start):
                # windows that begin within a stretch: sums of signs by differences, whatever the windows' size
                part = start[i : np.searchsorted(start, start[i] + STRETCH)]
                i += len(part)
                lo, hi = int(part[0]), int(part[-1]) + m - k + 1
                upto_sign = np.zeros((hi - lo + 1, BITS), np.int32)
                for j in range(lo, hi, STRETCH):
                    np.cumsum(_signs(s[j : min(j + STRETCH, hi)]), axis=0, dtype=np.int32, out=upto_sign[j - lo + 1 : min(j + STRETCH, hi) - lo + 1])
                    upto_sign[j - lo + 1 : min(j + STRETCH, hi) - lo + 1] += upto_sign[j - lo]
                sums = upto_sign[part - lo + m - k + 1] - upto_sign[part - lo]
                for w, items in zip(part.tolist(), self.near(_fingerprint(sums)), strict=True):
                    mine = Counter(s[w : w + m - k + 1].tolist()) if len(items) else None
                    for item in items.tolist():
                        if item in same:
                            common = sum((mine & self.counts[item]).values())
                            similarity = common / (2 * (m - k + 1) - common)
                            if similarity >= SIMILARITY:
                                yield int(words.doc[w]), item, similarity, w - int(words.at[words.doc[w]])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).toLocalIterator():
        if block and (len(block) >= ITEMS_AT_ONCE or size + len(r.text) > BYTES_AT_ONCE):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document for each item it holds."""
    rows = K.bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def searcher(block: list[tuple[int | None, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [x for k in range(1, SHINGLE + 1) if len((x := Index(block, k)).shingles)]
            for batch in batches:
                for c in K.chunks(batch.column(1)):
                    words = K.Words(c, _WORD)
                    word_hash = K.word_hashes(c, words)
                    best: dict[tuple[int, int, int], tuple[float, int]] = {}
                    for x, index in enumerate(indexes):
                        for doc, item, similarity, first in index.search(c, words, word_hash):
                            if (similarity, -first) > best.get((x, doc, item), (0.0, 0)):
                                best[x, doc, item] = similarity, -first
                    if best:
                        ids = batch.column(0).slice(c.first, c.n)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[d].as_py() for _, d, _ in best], pa.int64()), pa.array([indexes[x].ids[i] for x, _, i in best], pa.int64()), pa.array([s for s, _ in best.values()], pa.float64()), pa.array([-f for _, f in best.values()], pa.int64()), pa.array([indexes[x].sizes[i] for x, _, i in best], pa.int64())],
                            ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                        )

        return run

    found = [rows.mapInArrow(searcher(block), SCHEMA) for block in _blocks(benchmark)]
    if not found:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words")).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"), "best.n_words")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows and columns of the documents that hold no benchmark item; each row is judged by its own text."""
    at = docs.columns.index("text")

    def keeper(block: list[tuple[int | None, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [x for k in range(1, SHINGLE + 1) if len((x := Index(block, k)).shingles)]
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for c in K.chunks(batch.column(at)):
                    words = K.Words(c, _WORD)
                    word_hash = K.word_hashes(c, words)
                    for index in indexes:
                        keep[[c.first + doc for doc, *_ in index.search(c, words, word_hash)]] = False
                yield batch.filter(pa.array(keep))

        return run

    return reduce(lambda df, block: df.mapInArrow(keeper(block), docs.schema), _blocks(benchmark), K.bounded(docs))
