"""Removal of repeated 50-byte strings by blockwise suffix sorting with a difference cover.

A suffix matters here only to its first 50 bytes, so the array is built for
those suffixes alone that can tie with one of another document:

1. Cover sample.  Positions whose place in the document, modulo 31, lies in a
   perfect difference set are sampled; for any two positions some shift below 31
   takes both into the sample.  A sampled suffix is ranked by its first 20 bytes,
   and only ranks that two documents share are kept.  As 30 + 20 <= 50, any two
   equal 50-byte strings of two documents hold a shared rank at a common shift.
2. Suffix buckets.  A suffix with a shared rank within reach goes to the bucket of
   the least fingerprint in its 50 bytes, so equal suffixes meet, and neighbours
   that go to one bucket travel as one stretch of text.
3. Buckets are sorted one at a time.  Long ties are told apart by the rank of the
   whole 50 bytes and confirmed byte by byte; in each class of equal suffixes all
   but those of the least doc_id are repeats.

A worker holds one chunk of text or one bucket, and there is a bucket for each
BUCKET_BYTES of text.  Stretches that are alike within a chunk go on once, and
those that many share once for a whole task, so that a passage of very many
documents costs its bucket one stretch a task or so.

Contract (op1): texts as UTF-8 bytes; each byte is removed that a 50-byte string
covers which also starts in a document with a smaller doc_id.

Edge cases: null text is empty, and nothing of it or of a text under 50 bytes is
removed; equal texts lose everything but the first copy's; rows that repeat a
doc_id do not remove each other, and each loses what it has itself in common with
smaller doc_ids; a null doc_id neither removes nor loses anything; a very long
text is one chunk, at some 60 bytes of memory a byte; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

LENGTH = 50
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
RANKED = LENGTH - PERIOD + 1

U = K.U
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 1 << 20


class Source:
    """The documents, how many buckets their bytes call for, and what tells rows of one doc_id apart.

    form is 0 but for doc_ids that come again, whose rows have the hash of their text.
    """

    def __init__(self, docs: DataFrame):
        self.docs, spark = K.bounded(docs), docs.sparkSession
        ids = self.docs.groupBy(F.col("doc_id").cast("long").alias("again")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        ids = K.written(ids, "suffix-ids")
        self.partitions = K.partitions_for(spark)
        self.buckets = max(8 * self.partitions, (ids.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES)
        self.again = K.written(ids.where("n > 1 AND again IS NOT NULL").select("again"), "suffix-again")
        K.discard(ids)
        self.forms = not self.again.isEmpty()

    def rows(self, *more: str) -> DataFrame:
        """doc_id, text, form, and more columns."""
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
        if not self.forms:
            return rows.withColumn("form", F.lit(0).cast("long"))
        return rows.join(self.again, F.col("doc_id") == F.col("again"), "left").withColumn("form", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(0)).drop("again")


#: Repeats that a task holds before it deals them out by document.
HELD_REPEATS = 500_000
#: A stretch that so many documents of a chunk share is looked for in the task's next chunks, too; how many are remembered before the task begins anew.
HOT, MET = 3, 200_000


def _pack_low(values: np.ndarray) -> bytes:
    """Three bytes of each."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _unpack_low(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return out.view("<u4")[:, 0]


def _pack_places(places: np.ndarray) -> bytes:
    """Ascending places as steps, of two bytes where they fit."""
    steps = np.diff(places, prepend=0)
    return steps.astype("<u2").tobytes() if not len(steps) or steps.max() < 65536 else b"\0" + steps.astype("<u4").tobytes()


def _unpack_places(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2").astype(np.int64) if len(raw) % 2 == 0 else np.frombuffer(raw[1:], "<u4").astype(np.int64))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each length, one after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


# ------------------------------------------------------------ 1. cover sample

_SAMPLE = "kind int, bucket int, chunk long, a binary, b binary"
#: Kinds of rows: sampled ranks of a chunk; a chunk's documents; places known to be shared.
_RANKS, _TABLE, _SHARED = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, chunk, a, b = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(chunk, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["kind", "bucket", "chunk", "a", "b"])


def sample(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the chunk, documents and ranks (64 bits) of the cover sample."""
    doc = np.repeat(np.arange(chunk.n, dtype=np.int32), np.diff(chunk.off))
    at = np.flatnonzero(_IN_COVER[(np.arange(len(doc)) - chunk.off[:-1][doc]) % PERIOD]) if len(doc) else np.zeros(0, np.int64)
    at = at[at + RANKED <= chunk.off[1:][doc[at]]]
    return at, doc[at], K.mix(K.window_hashes(chunk.data, RANKED)[at]) if len(at) else np.zeros(0, np.uint64)


def shared_places(source: Source) -> DataFrame:
    """doc_id, form and the places (binary, int32) of its sampled suffixes whose rank another document shares."""
    n_buckets, n = source.buckets, source.partitions

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                ids = batch.column(0).slice(c.first, c.n).to_numpy(zero_copy_only=False).astype(np.int64)
                forms = batch.column(2).slice(c.first, c.n).to_numpy().astype(np.int64)
                key = int.from_bytes(hashlib.blake2b(ids.tobytes() + c.off.tobytes() + hashlib.blake2b(c.data.tobytes(), digest_size=16).digest(), digest_size=8).digest(), "little", signed=True)
                at, doc, rank = sample(c)
                order = np.argsort(rank, kind="stable")
                at, doc, rank = at[order], doc[order], rank[order]
                starts = K.runs(rank)
                length = np.diff(np.append(starts, len(rank)))
                # a doc_id may come again after another one, so a run's ends do not tell
                of = ids[doc]
                several = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts) if len(starts) else np.zeros(0, bool)
                inside = np.repeat(several, length)
                send = ~inside
                send[starts] = True
                rows = [(_TABLE, key % n_buckets, key, ids.tobytes() + forms.tobytes(), c.off.tobytes())]
                if inside.any():
                    rows.append((_SHARED, key % n_buckets, key, _pack_places(np.sort(at[inside])), b""))
                at, rank = at[send], rank[send]
                bucket = ((rank >> U(32)) * U(n_buckets) >> U(32)).astype(np.int64)
                order = np.lexsort((at, bucket))
                at, rank, cuts = at[order], rank[order], K.split_points(bucket[order], n_buckets)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    rows.append((_RANKS, k, key, _pack_low(rank[cuts[k] : cuts[k + 1]]), _pack_places(at[cuts[k] : cuts[k + 1]])))
                yield _rows(rows)
        K.trim()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(bucket: int, held: list) -> pa.RecordBatch:
            ranks = [_unpack_low(a) for _, a, _ in held]
            places = np.concatenate([_unpack_places(b) for _, _, b in held])
            source = np.repeat(np.arange(len(held)), [len(x) for x in ranks])
            key = (np.concatenate(ranks).astype(np.uint64) << U(32)) | source.astype(np.uint64)
            order = np.argsort(key, kind="stable")
            rank, source, places = (key[order] >> U(32)), source[order], places[order]
            starts = K.runs(rank)
            length = np.diff(np.append(starts, len(rank)))
            chunk = np.array([c for c, _, _ in held])
            keep = np.repeat(chunk[source[starts]] != chunk[source[starts + length - 1]], length)
            source, places = source[keep], places[keep]
            order = np.lexsort((places, source))
            source, places = source[order], places[order]
            cuts = K.split_points(source, len(held))
            return _rows([(_SHARED, bucket, held[i][0], _pack_places(places[cuts[i] : cuts[i + 1]]), b"") for i in np.flatnonzero(np.diff(cuts)).tolist()])

        at, held = None, []
        for batch in batches:
            passed = []
            for kind, bucket, chunk, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if kind != _RANKS:
                    passed.append((kind, bucket, chunk, a, b))
                    continue
                if bucket != at and held:
                    yield flush(at, held)
                    held = []
                at = bucket
                held.append((chunk, a, b))
            if passed:
                yield _rows(passed)
        if held:
            yield flush(at, held)
        K.trim()

    def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            ids, off = next((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)) for kind, a, b in held if kind == _TABLE)
            ids, forms = ids.reshape(2, -1)
            places = [_unpack_places(a) for kind, a, _ in held if kind == _SHARED]
            places = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
            cuts = np.searchsorted(places, off)
            use = np.flatnonzero(np.diff(cuts))
            found = [(places[cuts[i] : cuts[i + 1]] - off[i]).astype("<i4").tobytes() for i in use.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(forms[use]), pa.array(found, pa.binary())], ["doc_id", "form", "places"])

        at, held = None, []
        for batch in batches:
            for kind, _, chunk, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if chunk != at and held:
                    yield flush(held)
                    held = []
                at = chunk
                held.append((kind, a, b))
        if held:
            yield flush(held)

    sampled = source.rows().where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH)).mapInArrow(local, _SAMPLE)
    replies = K.written(sampled.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "chunk").mapInArrow(compare, _SAMPLE), "suffix-shared")
    return replies.repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(by_document, "doc_id long, form long, places binary")


# ---------------------------------------------------------- 2. suffix buckets

_BUCKET = "kind int, bucket int, docs binary, starts binary, lengths binary, text binary"
_STRETCH, _REPEATS = 0, 1


def stretches(chunk: K.Chunk, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place in the chunk, number of suffixes, document and bucket fingerprint of each stretch of suffixes to sort."""
    n = len(chunk.data)
    mark = np.concatenate([p + chunk.off[i] for i, p in enumerate(places)]) if places else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(places)), [len(p) for p in places])
    lo = np.maximum(mark - (LENGTH - RANKED), chunk.off[doc])
    hi = np.minimum(mark, chunk.off[1:][doc] - LENGTH) + 1
    ok = hi > lo
    cover = np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok], minlength=n + 1)
    at = np.flatnonzero(np.cumsum(cover)[:n] > 0)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    grams = np.full(n + PERIOD, np.uint64(0xFFFFFFFFFFFFFFFF))
    grams[: n - RANKED + 1] = K.window_hashes(chunk.data, RANKED)
    least, width = grams, 1
    while width * 2 <= PERIOD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - PERIOD + 1], least[PERIOD - width : n - width + 1])[at]
    doc = np.searchsorted(chunk.off, at, "right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), doc[first], least[first]


def _bucket_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["kind", "bucket", "docs", "starts", "lengths", "text"])


def _repeat_rows(ids: np.ndarray, forms: np.ndarray, start: np.ndarray, end: np.ndarray, n_buckets: int) -> list[tuple]:
    """Repeated stretches, as bytes start..end of documents, dealt by document."""
    bucket = (K.mix(ids.view(np.uint64) + forms.view(np.uint64)) % U(n_buckets)).astype(np.int64)
    order = np.lexsort((start, forms, ids, bucket))
    ids, forms, start, end = ids[order], forms[order], start[order], end[order]
    cuts = K.split_points(bucket[order], n_buckets)
    return [(_REPEATS, k, ids[x:y].tobytes() + forms[x:y].tobytes(), start[x:y].astype("<i4").tobytes(), end[x:y].astype("<i4").tobytes(), b"") for k, x, y in ((k, cuts[k], cuts[k + 1]) for k in np.flatnonzero(np.diff(cuts)).tolist())]


# ------------------------------------------------------------ 3. bucket sort


def sort_bucket(text: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of stretches laid end to end: (stretch, first, end) in bytes of the stretch, covered by suffixes that a smaller id has too."""
    base = np.cumsum(lengths) - lengths
    count = lengths - LENGTH + 1
    stretch = np.repeat(np.arange(len(ids)), count)
    at = _ragged(base, count)
    key = K.window_hashes(text, LENGTH)[at] if len(at) else np.zeros(0, np.uint64)
    owner = ids[stretch]
    order = np.argsort(key)
    starts = K.runs(key[order])
    length = np.diff(np.append(starts, len(key)))
    repeat = np.zeros(len(at), bool)
    if not len(order):
        return (np.zeros(0, np.int64),) * 3
    owners = owner[order]
    least = np.minimum.reduceat(owners, starts)
    shared = np.repeat(np.maximum.reduceat(owners, starts) > least, length)
    order, owners, group = order[shared], owners[shared], np.repeat(np.arange(len(starts)), length)[shared]
    repeat[order] = owners > least[group]
    # neighbours in a class of equal keys are equal byte by byte, or else the class is looked at by itself
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word, place = np.ndarray((len(text) + 1,), "<u8", padded, strides=(1,)), at[order]
    differ = np.zeros(max(0, len(order) - 1), bool)
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = word[place + j]
        differ |= w[1:] != w[:-1]
    differ &= group[1:] == group[:-1]
    for g in np.unique(group[1:][differ]).tolist():
        first_of: dict[bytes, int] = {}
        members = order[group == g]
        for m in members.tolist():
            s = text[at[m] : at[m] + LENGTH].tobytes()
            first_of[s] = min(first_of.get(s, owner[m]), owner[m])
        for m in members.tolist():
            repeat[m] = owner[m] > first_of[text[at[m] : at[m] + LENGTH].tobytes()]
    hit = np.flatnonzero(repeat)
    if not len(hit):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (stretch[hit[1:]] != stretch[hit[:-1]])])
    first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
    s = stretch[first]
    return s, at[first] - base[s], at[last] - base[s] + LENGTH


def _ids_and_forms(held: list) -> np.ndarray:
    return np.concatenate([np.frombuffer(x[0], np.int64).reshape(2, -1) for x in held], axis=1)


def spans(source: Source) -> DataFrame:
    """doc_id, form, starts and ends (binary, int32): the maximal runs of removed bytes of every row that has any; alike for rows alike."""
    n_buckets, n = source.buckets, source.partitions
    shared = K.written(shared_places(source).dropDuplicates(["doc_id", "form"]) if source.forms else shared_places(source), "suffix-places")
    # rows that are alike in doc_id and text find the same runs, each for itself
    marked = source.rows().join(shared, ["doc_id", "form"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        met: dict[int, int] = {}  # stretches that came again, and the smallest id that this task has sent with them
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                part = batch.slice(c.first, c.n)
                ids = part.column(0).to_numpy().astype(np.int64)
                first, count, doc, fingerprint = stretches(c, [np.frombuffer(x, "<i4") for x in part.column(3).to_pylist()])
                length, owner, start = count + LENGTH - 1, ids[doc], first - c.off[doc]
                form = part.column(2).to_numpy().astype(np.int64)[doc]
                # alike within the chunk: only the smallest id's go on, the others are repeats
                same = K.span_hash(K.prefix_hash(c.data), first, first + length)
                order = np.lexsort((owner, same))
                heads = K.runs(same[order])
                number = np.diff(np.append(heads, len(order)))
                head_key, head_id = same[order[heads]].tolist(), owner[order[heads]]
                if met:
                    head_id = np.array([min(i, met.get(k, i)) for k, i in zip(head_key, head_id.tolist(), strict=True)], np.int64)
                if len(met) > MET:
                    met.clear()
                met.update((head_key[i], int(head_id[i])) for i in np.flatnonzero(number >= HOT).tolist())
                least = np.empty(len(order), np.int64)
                least[order] = np.repeat(head_id, number) if len(heads) else 0
                again = owner > least
                rows = _repeat_rows(owner[again], form[again], start[again], start[again] + length[again], n)
                first, length, owner, start, fingerprint, form = (x[~again] for x in (first, length, owner, start, fingerprint, form))
                bucket = (K.mix(fingerprint) % U(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = K.split_points(bucket[order], n_buckets)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    o = order[cuts[k] : cuts[k + 1]]
                    rows.append((_STRETCH, k, owner[o].tobytes() + form[o].tobytes(), start[o].astype("<i4").tobytes(), length[o].astype("<i4").tobytes(), squeeze.compress(c.data[_ragged(first[o], length[o])].tobytes())))
                yield _bucket_rows(rows)
        K.trim()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor()

        def flush(held: list) -> tuple[np.ndarray, ...]:
            ids, forms = _ids_and_forms(held)
            start = np.frombuffer(b"".join(x[1] for x in held), "<i4").astype(np.int64)
            length = np.frombuffer(b"".join(x[2] for x in held), "<i4").astype(np.int64)
            s, a, b = sort_bucket(np.frombuffer(b"".join(loosen.decompress(x[3]) for x in held), np.uint8), ids, length)
            return ids[s], forms[s], start[s] + a, start[s] + b

        def dealt(found: list) -> pa.RecordBatch:
            return _bucket_rows(_repeat_rows(*(np.concatenate(x) for x in zip(*found, strict=True)), n))

        at, held, found = None, [], []
        for batch in batches:
            passed = []
            for kind, bucket, *rest in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if kind == _REPEATS:
                    passed.append((kind, bucket, *rest))
                    continue
                if bucket != at and held:
                    found.append(flush(held))
                    held = []
                at = bucket
                held.append(rest)
            if passed:
                yield _bucket_rows(passed)
            if sum(len(x[0]) for x in found) > HELD_REPEATS:
                yield dealt(found)
                found = []
        if held:
            found.append(flush(held))
        if found:
            yield dealt(found)
        K.trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list) -> pa.RecordBatch:
            ids, forms = _ids_and_forms(held)
            start = np.frombuffer(b"".join(x[1] for x in held), "<i4").astype(np.int64)
            end = np.frombuffer(b"".join(x[2] for x in held), "<i4").astype(np.int64)
            order = np.lexsort((start, forms, ids))
            ids, forms, start, end = ids[order], forms[order], start[order], end[order]
            at = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (forms[1:] != forms[:-1])])) if len(ids) else np.zeros(0, np.int64)
            cuts = np.append(at, len(ids))
            out_s, out_e = [], []
            for i in range(len(at)):
                s, e = start[cuts[i] : cuts[i + 1]], np.maximum.accumulate(end[cuts[i] : cuts[i + 1]])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                out_s.append(s[new].astype("<i4").tobytes())
                out_e.append(e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(forms[at]), pa.array(out_s, pa.binary()), pa.array(out_e, pa.binary())], ["doc_id", "form", "starts", "ends"])

        at, held = None, []
        for batch in batches:
            for _, bucket, *rest in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if bucket != at and held:
                    yield flush(held)
                    held = []
                at = bucket
                held.append(rest)
        if held:
            yield flush(held)

    dealt = marked.select("doc_id", "text", "form", "places").mapInArrow(deal, _BUCKET)
    repeats = K.written(dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(sort, _BUCKET), "suffix-repeats")
    return repeats.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(merge, "doc_id long, form long, starts binary, ends binary")


def _cut(text: bytes, starts: bytes, ends: bytes) -> bytes:
    out, at = [], 0
    for s, e in zip(np.frombuffer(starts, "<i4").tolist(), np.frombuffer(ends, "<i4").tolist(), strict=True):
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    source = Source(docs)
    found = K.written(spans(source), "suffix-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode("utf-8")
                kept = _cut(raw, starts, ends)
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(starts) // 4, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) if rows else batch.slice(0, 0).select([0])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    some = source.rows().join(found, ["doc_id", "form"]).select("doc_id", "text", "starts", "ends").mapInArrow(cut, schema)
    text = F.coalesce("text", F.lit(""))
    none = source.rows().select("doc_id", "form", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"))
    return some.unionByName(none.join(found.select("doc_id", "form"), ["doc_id", "form"], "left_anti").drop("form"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of documents, texts without their repeated bytes; a character that is cut into goes whole."""
    source = Source(docs)
    found = K.written(spans(source), "suffix-spans")
    names = docs.columns
    key, form, starts, ends = (K.fresh(x, docs) for x in ("key", "form", "starts", "ends"))
    found = found.select(F.col("doc_id").alias(key), F.col("form").alias(form), F.col("starts").alias(starts), F.col("ends").alias(ends))
    same = F.col("doc_id").cast("long") == F.col(key)
    # a doc_id that does not come again has form 0
    joined = docs.join(found, same & ((F.col(form) == 0) | (F.col(form) == F.xxhash64("text"))) if source.forms else same, "left").select(*names, starts, ends)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1)), strict=True)
            texts = [t if s is None else _cut(t.encode("utf-8"), s, e).decode("utf-8", "ignore") for t, s, e in rows]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names)
        K.trim()

    return joined.mapInArrow(cut, docs.schema)
