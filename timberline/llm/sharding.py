"""Sharding by a k-d tree over metadata.

Documents are put together by equal text, and the groups are split recursively
at the byte-weighted median of the node's widest metadata dimension, until the
leaves reach the target bytes.  Medians are found by distributed histograms of
which the driver sees a fixed number of bins.  A group larger than a small
share of a leaf is the one kind that is taken apart, by a hash of doc_id.

Contract (op10): law `bytes`; size is UTF-8 bytes plus 1, a null text counting as
empty; slots are gapless from 0 in each shard; grown_shard is null.

Edge cases: null metadata sorts before all other; ties of a dimension are split
by a hash of the text, so smaller groups stay together; repeated rows are each
placed; other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K

SHARDS = 16
#: Bins of a histogram for each node; a bin with less than this share of its node's bytes is not looked into further.
BINS, FINE = 2048, 0.0005
#: Share of a leaf's size above which a group is taken apart, and pieces of a leaf's size that it is taken apart into.
SHARE, PIECES = 1 / 16, 32
_HIGH = 30


def _scaled(value: Column, low: float, high: float, tie: Column) -> Column:
    """30 bits of the value's place between low and high, then 32 bits of the tie."""
    width = max(1.0, float(high) - float(low))
    v = F.floor((F.coalesce(value.cast("double"), F.lit(float(low))) - F.lit(float(low))) / F.lit(width) * F.lit(float((1 << _HIGH) - 1))).cast("long")
    return F.shiftleft(v, 32) + F.pmod(tie, F.lit(1 << 32))


def _numbered(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.crc32(F.col(c).cast("string")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        code("lang").alias("lang"),
        code("source").alias("source"),
    )


#: The metadata dimensions of a group: its least doc_id, size of one text, language and source.
DIMENSIONS = ("first_id", "one_size", "lang", "source")


def _cuts(groups: DataFrame, leaves: int) -> list[tuple[int, int, int, int]]:
    """(node, dimension, key below which rows go left, left's first leaf is the node's) of each split, level by level.

    A node is named by its first leaf; a node of n leaves gives the right child the name of its first leaf plus n / 2.
    """
    cuts: list[tuple[int, int, int, int]] = []
    span = leaves
    while span > 1:
        named = groups.withColumn("node", node_of(cuts))
        stats = {r.node: r for r in named.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(f"k{i}").alias(f"{n}{i}") for i in range(len(DIMENSIONS)) for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
        open_: dict[int, dict] = {}
        for node, r in stats.items():
            width = [(r[f"hi{i}"] >> 32) - (r[f"lo{i}"] >> 32) for i in range(len(DIMENSIONS))]
            d = max(range(len(DIMENSIONS)), key=lambda i: width[i])
            open_[node] = {"d": d, "lo": r[f"lo{d}"], "hi": r[f"hi{d}"], "below": 0, "half": r.bytes / 2, "bytes": r.bytes}
        done: dict[int, tuple[int, int]] = {}
        while open_:
            pick = lambda what: F.element_at(F.create_map(*(F.lit(x) for n, o in open_.items() for x in (n, what(o)))), F.col("node"))
            key = F.element_at(F.array(*(f"k{i}" for i in range(len(DIMENSIONS)))), pick(lambda o: o["d"] + 1))
            step = lambda o: (o["hi"] - o["lo"]) // BINS + 1
            inside = named.where(F.col("node").isin(list(open_))).withColumn("key", key).withColumn("lo", pick(lambda o: o["lo"])).where((F.col("key") >= F.col("lo")) & (F.col("key") <= pick(lambda o: o["hi"])))
            bins = inside.groupBy("node", F.expr("(key - lo)").alias("off"), pick(step).alias("step")).agg(F.sum("bytes").alias("bytes")).groupBy("node", F.expr("off div step").alias("bin")).agg(F.sum("bytes").alias("bytes"), F.min("off").alias("lo"), F.max("off").alias("hi")).collect()
            for node, o in list(open_.items()):
                for b in sorted((b for b in bins if b.node == node), key=lambda b: b.bin):
                    if o["below"] + b.bytes < o["half"]:
                        o["below"] += b.bytes
                        continue
                    lo, hi = o["lo"] + b.lo, o["lo"] + b.hi
                    if lo == hi or b.bytes <= FINE * o["bytes"]:
                        after = o["below"] + b.bytes - o["half"] <= o["half"] - o["below"]
                        done[node] = o["d"], hi + 1 if after else lo
                        del open_[node]
                    else:
                        o["lo"], o["hi"] = lo, hi
                    break
                else:
                    done[node] = o["d"], o["hi"] + 1
                    del open_[node]
        span //= 2
        cuts += [(node, d, at, node + span) for node, (d, at) in sorted(done.items())]
    return cuts


def node_of(cuts: list[tuple[int, int, int, int]]) -> Column:
    """The leaf (or the node so far) of a row with keys k0, k1, ..."""
    children = {}
    for node, d, at, right in cuts:
        children.setdefault(node, []).append((d, at, right))

    def walk(node: int, level: int) -> Column:
        if node not in children or level >= len(children[node]):
            return F.lit(node)
        d, at, right = children[node][level]
        # the right child's own splits begin with the next level
        return F.when(F.col(f"k{d}") < F.lit(at), walk(node, level + 1)).otherwise(walk(right, 0))

    return walk(0, 0)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; shards is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    rows = K.written(_numbered(docs), "sharding")
    by_text = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("doc_id", "size") for n, f in (("lo", F.min), ("hi", F.max)))).first()
    target = (whole.bytes or 0) / shards
    # fewer than shards / SHARE groups can be larger than that share of a leaf
    large = by_text.where(F.col("bytes") > target * SHARE).select(F.col("h1").alias("l1"), F.col("h2").alias("l2"), (F.floor(F.col("bytes") * PIECES / F.lit(max(target, 1))) + 1).cast("long").alias("pieces"))
    piece = F.when(F.col("pieces").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")
    rows = rows.join(F.broadcast(large), (F.col("h1") == F.col("l1")) & (F.col("h2") == F.col("l2")), "left").withColumn("piece", piece).drop("l1", "l2", "pieces")
    groups = rows.groupBy("h1", "h2", "piece").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first_id"), F.max("size").alias("one_size"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    ranges = {"first_id": (whole.lo_doc_id or 0, whole.hi_doc_id or 0), "one_size": (whole.lo_size or 0, whole.hi_size or 0), "lang": (-1, 1 << 32), "source": (-1, 1 << 32)}
    tie = F.xxhash64("h1", "h2", "piece")
    groups = K.written(groups.select("h1", "h2", "piece", "bytes", *(_scaled(F.col(d), *ranges[d], tie).alias(f"k{i}") for i, d in enumerate(DIMENSIONS))), "sharding-groups")
    placed = groups.select("h1", "h2", "piece", node_of(_cuts(groups, shards)).cast("int").alias("shard"))
    parts = min(4096, max(32, (whole.n or 0) // (shards * 50_000)))
    rows = K.written(rows.join(placed, ["h1", "h2", "piece"]).select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(parts)).cast("int").alias("part")), "sharding-placed")
    # slots: counts of shards x parts, whatever the number of rows
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select(F.col("shard").alias("c_shard"), F.col("part").alias("c_part"), (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1 + F.col("before")
    return rows.join(F.broadcast(before), (F.col("shard") == F.col("c_shard")) & (F.col("part") == F.col("c_part"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
