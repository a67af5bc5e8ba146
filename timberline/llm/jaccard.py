"""N-gram Jaccard join by universe partition and pigeonhole.

Sets are banded by size so that partners lie in the same or the next band.  In
a band's scheme, tokens are hashed into segments; if two sets differ in at most
H tokens, and the segments' budgets plus one sum to more than H, then in some
segment they differ within its budget.  Budget 0 is indexed by the segment's
subset, budget 1 also by its one-deletion neighbourhood; which segments get
which, and how many there are, is chosen by cost.  An empty segment would be
shared by many, so a set leaves its empty segments out as long as the spare
budget makes up for that.

What is indexed is the distinct set, named by its digest, so that a group of
copies, however large, is one member of its entries.  Sets that share an entry
are not paired with each other but with the entry's first; a second round takes
only those entries whose sets are not yet in one component, one of all entries
with the same members, and pairs across components alone.  Bounds on size and on
a parity sketch that grows with the set, both never too high, come before exact
verification.

Contract (op6): 4-word shingles of words lower-cased in A-Z; links where
100 * intersection >= 85 * union; component_id is the least doc_id reachable.

Edge cases: a null or empty text, or one without words, has no shingles and no
links; with fewer than 4 words its whole sequence is the one shingle; rows with
the same doc_id are one node, which links if any of its texts does; rows with a
null doc_id get a null component_id; other columns are ignored, whatever their
names; an empty table gives an empty result.  A very long text is one set like
any other: its worker holds 8 bytes a shingle and a sketch of 1/32 to 1/64 of that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .components import components

PERCENT, SHINGLE = 85, 4
#: Bits of the smallest sketch, and the least bits a shingle of a larger one.
SKETCH_BITS, BITS_A_SHINGLE = 512, 1
#: The cost model: share of a document's shingles that others may hold too, and the cost of an entry shared by chance against that of writing one.
SHARED, COLLISION = 0.6, 50.0

#: Second round: segments a set, in multiples of those by which it is indexed; entries a set by which its pairs are told to have been met before; members of an entry that a task compares with all others.
FINER, FORMER, SLICE = 3, 16, 512

U = K.U


@lru_cache(None)
def band_starts(percent: int = PERCENT) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


@lru_cache(None)
def scheme(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments, how many of them with budget 1, spare budget) for pairs whose smaller set lies in the band."""
    low, differ, best = int(band_starts(percent)[band]), _differ(band, percent), None
    for spare in (0, 1, 2, 3, 4, 6):
        need = differ + 1 + spare
        for m in {need, *(need - need * i // 16 for i in range(1, 9))}:
            ones = need - m
            if m < 1 or ones > m or ones < 0:
                continue
            c = low / m
            empty = m * math.exp(-c) * (1 + ones / m)
            miss = 1 - sum(math.exp(-empty) * empty**i / math.factorial(i) for i in range(spare + 1))
            cost = (m - ones) * (1 + COLLISION * SHARED**c) + ones * (1 + c) * (1 + COLLISION * SHARED ** max(c - 1, 0)) + miss * m * COLLISION
            if best is None or cost < best[0]:
                best = cost, (m, ones, spare)
    return best[1]


def _differ(band: int, percent: int = PERCENT) -> int:
    """In how many tokens linked sets may differ if the smaller one lies in the band."""
    high = int(band_starts(percent)[band + 1]) - 1
    return (100 - percent) * (high + high * 100 // percent) // (100 + percent)


class Segments:
    """The tokens of some documents, hashed into m[i] segments of document use[i]; one cell a segment.

    doc, seg: of each cell; count: its tokens; total: the sum of their values; cell, value: of each token.
    """

    __slots__ = ("doc", "seg", "count", "total", "salt", "cell", "value")

    def __init__(self, doc: np.ndarray, h: np.ndarray, n: int, use: np.ndarray, of: np.ndarray, m: np.ndarray):
        base = np.concatenate([[0], np.cumsum(m)])
        local = np.full(n, -1, np.int64)
        local[use] = np.arange(len(use))
        tok = np.flatnonzero(local[doc] >= 0) if len(use) < n else np.arange(len(doc))
        d = local[doc[tok]]
        v = K.mix(h[tok])
        self.cell = base[d] + (((v >> U(32)) * m[d].astype(np.uint64)) >> U(32)).astype(np.int64)
        self.value = K.mix(v ^ U(0xA24BAED4963EE407))
        cells = int(base[-1])
        self.count = np.bincount(self.cell, minlength=cells)
        low = np.bincount(self.cell, (self.value & U(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
        self.total = low + (np.bincount(self.cell, (self.value >> U(32)).astype(np.float64), cells).astype(np.uint64) << U(32))
        self.doc = np.repeat(np.arange(len(use)), m)
        self.seg = np.arange(cells) - base[self.doc]
        self.salt = K.mix(self.seg.astype(np.uint64) * U(0x9FB21C651E98DF25) + of[self.doc].astype(np.uint64) * U(0xC2B2AE3D27D4EB4F) + U(1))


def _in_bands(doc: np.ndarray, n: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, band whose scheme they are indexed by): each set's own band, for partners of its size or more, and the one before, for smaller ones."""
    size = np.diff(K.split_points(doc, n))
    band = np.searchsorted(band_starts(percent), size, "right") - 1
    for back in (0, 1):
        use = np.flatnonzero((size > 0) & (band >= back))
        if len(use):
            yield use, band[use] - back


def entries(doc: np.ndarray, h: np.ndarray, n: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(document, entry) of all index entries of the sets given by sorted distinct (document, token)."""
    out_doc, out = [], []
    for use, of in _in_bands(doc, n, percent):
        m, ones, spare = np.array([scheme(int(b), percent) for b in np.unique(of)])[np.unique(of, return_inverse=True)[1]].T
        s = Segments(doc, h, n, use, of, m)
        single = s.seg < ones[s.doc]
        weak = (s.count == 0) | (single & (s.count <= 1))
        lost = np.bincount(s.doc[weak], np.where(single[weak], 2, 1), len(use))
        all_kept = (lost > spare)[s.doc]  # only then are entries of the empty subset written
        keep = (s.count > 0) | all_kept
        out_doc.append(use[s.doc[keep]])
        out.append(K.mix(s.total[keep] + s.salt[keep]))
        one = single[s.cell] & ((s.count[s.cell] > 1) | all_kept[s.cell])
        at = s.cell[one]
        out_doc.append(use[s.doc[at]])
        out.append(K.mix(s.total[at] - s.value[one] + s.salt[at]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out)


def fine_entries(doc: np.ndarray, h: np.ndarray, n: int, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(document, band, need, empty, entry): FINER times as many segments as linked sets must have in common, all with budget 0.

    If linked sets differ in at most H tokens, all but H of their segments are
    alike.  So in any order of all entries that is the same for all sets, the first
    H + 1 (need) of the one and of the other have one in common.  Empty segments
    come last in that order, and are written only where there are too few others.
    """
    out = [[], [], [], [], []]
    for use, of in _in_bands(doc, n, percent):
        need = np.array([_differ(int(b), percent) + 1 for b in np.unique(of)])[np.unique(of, return_inverse=True)[1]]
        s = Segments(doc, h, n, use, of, FINER * need)
        full = np.bincount(s.doc[s.count > 0], minlength=len(use))
        keep = ((s.count > 0) | (full < need)[s.doc]) & (need > 1)[s.doc]  # sets that may not differ are equal
        for column, x in zip(out, (use[s.doc], of[s.doc], need[s.doc], s.count == 0, K.mix(s.total + s.salt)), strict=True):
            column.append(x[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _docs(docs: DataFrame) -> DataFrame:
    return K.bounded(docs).select(F.col("doc_id").cast("long").alias("node"), "text")


def _chunk_sets(batch: pa.RecordBatch) -> Iterator[tuple[K.Chunk, np.ndarray, np.ndarray, pa.RecordBatch]]:
    for c in K.chunks(batch.column(1)):
        doc, h, _ = K.doc_shingles(c, SHINGLE)
        doc, h = K.doc_sets(doc, h)
        yield c, doc, h, batch.slice(c.first, c.n)


def _digest(doc: np.ndarray, h: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each of n sets."""
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
        v = K.mix(h ^ U(seed))
        total = np.bincount(doc, (v & U(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64) + (np.bincount(doc, (v >> U(32)).astype(np.float64), n).astype(np.uint64) << U(32))
        out.append(K.mix(total).view(np.int64))
    return out


def _names(doc: np.ndarray, h: np.ndarray, n: int, clash: np.ndarray) -> np.ndarray:
    """The sets' names: the first hash, or both where other sets have the first too."""
    one, two = _digest(doc, h, n)
    return np.where(np.isin(one, clash), K.mix(one.view(np.uint64) * U(3) + two.view(np.uint64)).view(np.int64), one) if len(clash) else one


def _sketch(h: np.ndarray, bits: int = SKETCH_BITS, least: float = BITS_A_SHINGLE) -> np.ndarray:
    """Parities of the tokens by the low bits of a hash; that of half the bits is the two halves' xor."""
    while bits < least * len(h):
        bits *= 2
    odd = (np.bincount((K.mix(h ^ U(0x1CE4E5B9BF58476D)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def nodes(docs: DataFrame, clash: tuple[int, ...] = ()) -> DataFrame:
    """node, n, two hashes, the name (null: no shingles, or no doc_id) and the parity sketches of every row's set, one by its size and a small one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(clash, np.int64)
        for b in batches:
            for c, doc, h, part in _chunk_sets(b):
                at = K.split_points(doc, c.n)
                one, two = _digest(doc, h, c.n)
                n, node = pa.array(np.diff(at).astype(np.int64)), part.column(0)
                name = pa.array(_names(doc, h, c.n, apart), mask=(np.diff(at) == 0) | node.is_null().to_numpy(zero_copy_only=False))
                sketches = (pa.array([_sketch(h[at[i] : at[i + 1]], least=least) for i in range(c.n)], pa.list_(pa.int64())) for least in (BITS_A_SHINGLE, 0))
                yield pa.RecordBatch.from_arrays([node, n, pa.array(one), pa.array(two), name, *sketches], ["node", "n", "h1", "h2", "name", "sketch", "small"])
        K.trim()

    return _docs(docs).mapInArrow(run, "node long, n long, h1 long, h2 long, name long, sketch array<long>, small array<long>")


def _known(docs: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """nodes(), written, and the first hashes that different sets share: one in 10**9 documents is rare, so they go to the driver."""
    known = K.written(nodes(docs), "jaccard-nodes")
    two = known.where("name IS NOT NULL").groupBy("h1").agg(F.min("h2").alias("lo"), F.max("h2").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    clash = tuple(r.h1 for r in two.where("lo <> hi OR least <> most").select("h1").toLocalIterator())
    if not clash:
        return known, clash
    K.discard(known)
    return K.written(nodes(docs, clash), "jaccard-nodes"), clash


_PACKED = "kind int, bucket int, a binary, b binary"


def _pack(kind: int, bucket: int, a: np.ndarray, b: np.ndarray) -> tuple:
    return kind, bucket, a.tobytes(), b.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, buckets, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(buckets, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["kind", "bucket", "a", "b"])


def _stars(entry: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of (entry, node): the first node of each entry; pairs of the first with each other; all members of entries with several."""
    order = np.lexsort((node, entry))
    entry, node = entry[order], node[order]
    if len(entry):
        fresh = np.concatenate([[True], (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])])
        entry, node = entry[fresh], node[fresh]
    at = K.runs(entry)
    length = np.diff(np.append(at, len(entry)))
    first = np.repeat(node[at], length) if len(at) else node
    rest = np.ones(len(entry), bool)
    rest[at] = False
    several = np.repeat(length > 1, length)
    pairs = np.unique(np.stack([first[rest], node[rest]], 1), axis=0) if rest.any() else np.zeros((0, 2), np.int64)
    return entry[at], node[at], pairs[:, 0], pairs[:, 1], entry[several], node[several]


def index(docs: DataFrame, percent: int = PERCENT, clash: tuple[int, ...] = ()) -> DataFrame:
    """Packed rows: kind 1 pairs of an entry's first set and another, kind 2 (entry, set) of entries with three sets or more.

    Within a chunk copies are one set, and an entry's first set alone goes on, so
    that what is dealt out of a group of copies is one row a chunk.
    """
    n_buckets = 8 * K.partitions_for(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(clash, np.int64)
        for b in batches:
            for c, doc, h, part in _chunk_sets(b):
                ids = _names(doc, h, c.n, apart)
                use = np.zeros(c.n, bool)
                use[np.unique(ids, return_index=True)[1]] = True  # copies within the chunk have the same entries
                if part.column(0).null_count:
                    known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                    use[:] = False
                    use[np.flatnonzero(known)[np.unique(ids[known], return_index=True)[1]]] = True
                here = use[doc]
                d, e = entries(doc[here], h[here], c.n, percent)
                e, node, pa_, pb, ge, gn = _stars(e, ids[d])
                rows = []
                for kind, key, x, y in ((0, e, e.view(np.int64), node), (1, pa_.view(np.uint64) + pb.view(np.uint64), pa_, pb), (2, ge, ge.view(np.int64), gn)):
                    bucket = (K.mix(key) % U(n_buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    cuts = K.split_points(bucket[order], n_buckets)
                    x, y = x[order], y[order]
                    rows += [_pack(kind, k, x[cuts[k] : cuts[k + 1]], y[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist()]
                yield _batch(rows)
        K.trim()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(bucket: int, held: dict[int, list]) -> pa.RecordBatch:
            join = lambda kind, i: np.concatenate([np.frombuffer(x[i], np.int64) for x in held[kind]]) if held[kind] else np.zeros(0, np.int64)
            entry, node = join(0, 0).view(np.uint64), join(0, 1)
            _, _, a, b, _, _ = _stars(entry, node)
            pairs = np.unique(np.stack([np.concatenate([a, join(1, 0)]), np.concatenate([b, join(1, 1)])], 1), axis=0)
            # of an entry with two nodes the one pair is all there is to test
            _, _, _, _, entry, node = _stars(np.concatenate([entry, join(2, 0).view(np.uint64)]), np.concatenate([node, join(2, 1)]))
            starts = K.runs(entry)
            length = np.diff(np.append(starts, len(entry)))
            three = np.repeat(length > 2, length)
            return _batch([_pack(1, bucket, pairs[:, 0], pairs[:, 1]), _pack(2, bucket, entry[three].view(np.int64), node[three])])

        at, held = None, {0: [], 1: [], 2: []}
        for batch in batches:
            for kind, bucket, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != at:
                    if at is not None:
                        yield flush(at, held)
                    at, held = bucket, {0: [], 1: [], 2: []}
                held[kind].append((a, b))
        if at is not None:
            yield flush(at, held)
        K.trim()

    packed = _docs(docs).mapInArrow(local, _PACKED)
    return packed.repartition(K.partitions_for(docs.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(gathered, _PACKED)


def _unpacked(packed: DataFrame, kind: int, names: tuple[str, str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
                for i in range(0, len(a), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 65536]), pa.array(b[i : i + 65536])], list(names))

    return packed.where(F.col("kind") == kind).select("a", "b").mapInArrow(run, f"{names[0]} long, {names[1]} long")


def _parted(a: str, b: str) -> F.Column:
    """In how many bits two sketches differ, the longer one folded; partners' sketches differ in length by a factor of two at most."""
    folded = lambda s: F.zip_with(F.slice(s, 1, (F.size(s) / 2).cast("int")), F.slice(s, (F.size(s) / 2).cast("int") + 1, (F.size(s) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    differ = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, n: t + n)
    a, b = F.col(a), F.col(b)
    return F.when(F.size(a) == F.size(b), differ(a, b)).when(F.size(a) > F.size(b), differ(folded(a), b)).otherwise(differ(a, folded(b)))


def _may_link(percent: int, sketch: str = "sketch") -> F.Column:
    """True for every linked pair (a_*, b_*): bounds on the sizes, and the parity sketches' difference."""
    size = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.least("a_n", "b_n") > 0)
    return F.when(size, _parted(f"a_{sketch}", f"b_{sketch}") * (100 + percent) <= (100 - percent) * (F.col("a_n") + F.col("b_n"))).otherwise(False)


def _side(table: DataFrame, side: str) -> DataFrame:
    return table.select(*(F.col(c).alias(f"{side}_{c}") for c in table.columns))


def _candidates(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that bounds do not rule out."""
    a, b = _side(sets, "a"), _side(sets, "b")
    return pairs.join(a, F.col("a") == F.col("a_name")).join(b, F.col("b") == F.col("b_name")).where(_may_link(percent)).select("a", "b")


def _texts_of(docs: DataFrame, names: DataFrame, sets: DataFrame) -> DataFrame:
    """node and text of a row for each set named, among others of the same doc_id."""
    # written, so that Spark knows its size and broadcasts it only below its own limit
    wanted = K.written(names.join(sets, "name").select(F.col("least").alias("w")).distinct(), "jaccard-wanted")
    return _docs(docs).join(wanted, F.col("node") == F.col("w"), "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, clash: tuple[int, ...] = (), percent: int = PERCENT) -> DataFrame:
    """a, b of the pairs of sets that are similar enough, exactly."""
    texts = _texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), sets)

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(clash, np.int64)
        for batch in batches:
            for c, doc, h, _ in _chunk_sets(batch):
                at = K.split_points(doc, c.n)
                yield pa.RecordBatch.from_arrays([pa.array(_names(doc, h, c.n, apart)), pa.array([h[at[i] : at[i + 1]].tobytes() for i in range(c.n)], pa.binary())], ["name", "tokens"])

    tokens = K.written(texts.mapInArrow(tokens_of, "name long, tokens binary"), "jaccard-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common) and len(both) > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    of_b = pairs.select("a", "b").join(tokens.select(F.col("name").alias("b"), F.col("tokens").alias("y")), "b")
    return of_b.join(tokens.select(F.col("name").alias("a"), F.col("tokens").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def _open(packed: DataFrame, found: DataFrame) -> DataFrame:
    """name of the sets that share an entry with a set of another component."""
    members = _unpacked(packed, 2, ("entry", "name")).distinct().join(found, "name", "left").select("entry", "name", F.coalesce("component", "name").alias("component"))
    members = K.written(members, "jaccard-members")
    open_ = members.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("entry").alias("open"))
    out = K.written(members.join(open_, F.col("entry") == F.col("open"), "left_semi").select("name").distinct(), "jaccard-open")
    K.discard(members)
    return out


def _across(docs: DataFrame, names: DataFrame, sets: DataFrame, found: DataFrame, clash: tuple[int, ...], percent: int) -> DataFrame:
    """a, b of different components among the sets named, with every linked pair, that bounds do not rule out.

    Entries are ordered by their cost, the pairs across components that they would
    make, and each set is indexed by its cheapest ones, as many as it needs: what is
    common to a group is skipped by all that have enough of their own.  Of entries
    with the same members one is enough; near copies share hundreds.
    """

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.array(clash, np.int64)
        for batch in batches:
            for c, doc, h, _ in _chunk_sets(batch):
                d, band, need, empty, entry = fine_entries(doc, h, c.n, percent)
                name = _names(doc, h, c.n, apart)[d]
                for i in range(0, len(d), 65536):
                    part = slice(i, i + 65536)
                    columns = name[part], band[part], need[part], empty[part].astype(bool), entry[part].astype(np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["of", "band", "need", "empty", "entry"])
        K.trim()

    group = names.join(found, "name", "left").select("name", F.coalesce("component", "name").alias("component"))
    rows = _texts_of(docs, names, sets).mapInArrow(fine, "of long, band long, need long, empty boolean, entry long").distinct()
    rows = K.written(rows.join(group, F.col("of") == F.col("name")).drop("of"), "jaccard-fine")
    alike = ["members", "sum", "xor"]
    by_component = rows.groupBy("entry", "component").agg(F.count("*").alias("n"))
    cost = by_component.groupBy("entry").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("cost"))
    ranked = rows.join(cost, "entry").withColumn("rank", F.row_number().over(Window.partitionBy("name", "band").orderBy("empty", "cost", "entry")))
    used = K.written(ranked.where("rank <= need AND cost > 0").select("entry", "name", "component"), "jaccard-used")
    K.discard(rows)
    shape = (F.count("*").alias("members"), F.sum(F.xxhash64("name").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), "name")).alias("xor"))
    once = used.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *shape).where("lo < hi")
    once = once.groupBy(*alike).agg(F.min("entry").alias("one")).select("one", F.ceil(F.col("members") / SLICE).cast("int").alias("slices"))
    rest = K.written(used.join(once, F.col("entry") == F.col("one")).drop("one"), "jaccard-rest")
    K.discard(used)
    # a pair is made at the first entry that it shares; the FORMER first ones of each side tell most others, and any that are left are dropped by distinct
    former = rest.groupBy("name").agg(F.slice(F.sort_array(F.collect_set("entry")), 1, FORMER).alias("former"))
    rest = K.written(rest.join(former, "name").join(sets.select("name", "n", "small"), "name"), "jaccard-rest")
    a = _side(rest.withColumn("slice", F.pmod(F.xxhash64("name"), F.col("slices")).cast("int")), "a")
    b = _side(rest.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))), "b")
    fresh = F.coalesce(F.array_min(F.array_intersect("a_former", "b_former")) >= F.col("a_entry"), F.lit(True))
    same = F.xxhash64("a_entry", "a_slice") == F.xxhash64("b_entry", "b_slice")  # one number; pairs that it makes by chance are told apart by their texts
    pairs = a.join(b, same & F.when(F.when(F.col("a_component") < F.col("b_component"), _may_link(percent, "small")).otherwise(False), fresh).otherwise(False))
    return _candidates(pairs.select(F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b")).distinct(), sets, percent)


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    known, clash = _known(docs)
    named = known.where("name IS NOT NULL")
    sets = K.written(named.groupBy("name").agg(F.min("node").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("small").alias("small")), "jaccard-sets")
    packed = K.written(index(docs, percent, clash), "jaccard-index")
    first = K.written(_candidates(_unpacked(packed, 1, ("a", "b")).distinct(), sets, percent), "jaccard-pairs")
    # rows that repeat a doc_id tie their sets
    several = named.groupBy("node").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi")
    tied = named.join(several, "node").select(F.col("lo").alias("a"), F.col("name").alias("b")).where("a <> b").distinct()
    links = K.written(verified(docs, first, sets, clash, percent).unionByName(tied), "jaccard-links")
    found = K.written(components(links).withColumnRenamed("node", "name"), "jaccard-components")
    open_ = _open(packed, found)
    K.discard(packed)
    if not open_.isEmpty():
        tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        across = K.written(_across(docs, open_, sets, found, clash, percent), "jaccard-across")
        more = K.written(verified(docs, across.join(tried, ["a", "b"], "left_anti"), sets, clash, percent), "jaccard-links")
        found = K.written(components(links.unionByName(more)).withColumnRenamed("node", "name"), "jaccard-components")
    linked = found.join(sets.select("name", "least"), "name")
    linked = found.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("name", "component_id")
    of_set = sets.join(linked, "name", "left").select("name", F.coalesce("component_id", "least").alias("component_id"))
    of_row = known.select("node", "n", "name").join(of_set, "name", "left")
    # a row without shingles goes where the other rows of its doc_id go
    bare = known.where("name IS NULL AND node IS NOT NULL").select(F.col("node").alias("bare")).distinct()
    moved = K.written(of_row.where("name IS NOT NULL").join(bare, F.col("node") == F.col("bare"), "left_semi").groupBy("node").agg(F.min("component_id").alias("moved")), "jaccard-moved")
    out = of_row.join(moved, "node", "left")
    return out.select(F.col("node").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "moved", "node").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows and columns of one document of each component, the one with the smallest doc_id.

    Of rows that repeat a doc_id the one with the least text stays; rows without a doc_id all stay.
    """
    groups = K.written(link_components(docs, percent), "jaccard-groups")
    other, again = K.fresh("other", docs), K.fresh("again", docs)
    others = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(other)).distinct()
    kept = docs.join(others, F.col("doc_id").cast("long") == others[other], "left_anti")
    repeated = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(again))
    if repeated.isEmpty():
        return kept
    rank = K.fresh("rank", docs)
    single = kept.join(repeated, F.col("doc_id").cast("long") == repeated[again], "left_anti")
    several = kept.join(repeated, F.col("doc_id").cast("long") == repeated[again], "left_semi")
    first = several.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1).drop(rank)
    return single.unionByName(first)
