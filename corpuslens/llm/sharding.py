"""Sharding by sampled splitters: a size-weighted sample of keys gives quantile boundaries,
records are range-partitioned between them, and overfull ranges are subdivided.

The law is ``bytes``: shard sizes are near equal.  The key is a hash of the text, so equal
texts are neighbours.  A group of equal texts stays in one shard as long as one has room
for it; larger groups are spread.

Defined results: null and empty texts have size 1; null and repeated doc_ids each take a
slot of their own; fewer records than shards leave shards empty; a text longer than a shard's
part fills one alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept, only

SHARDS = 8
#: Keys drawn to place the splitters, on average.
SAMPLE_KEYS = 4096
#: Bytes of text in a range, about; ranges of twice the mean are subdivided until only ranges of
#: one key are left over it.  Very large inputs have ``MAX_RANGES`` ranges of more bytes.
RANGE_BYTES = 64 << 20
MIN_RANGES, MAX_RANGES = 32, 16_384
#: Groups of equal texts over this share of a shard are placed one by one.
GROUP_SHARE = 1 / 64
#: Parts in which a large group's rows are numbered.
GROUP_PARTS = 64


def _splitters(records: DataFrame, total: int, ranges: int, sample_keys: int) -> list[int]:
    """Quantiles of a sample that draws each record with a chance in proportion to its size."""
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(sample_keys / max(total, 1)))
    draw = (F.pmod(F.xxhash64("key", "doc_id", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)) < chance
    drawn = sorted((r["key"], max(1.0, r["size"] * sample_keys / total)) for r in records.filter(draw).select("key", "size").toLocalIterator())
    whole, so_far, out = sum(w for _, w in drawn), 0.0, []
    for key, weight in drawn:
        so_far += weight
        if len(out) < ranges - 1 and so_far >= whole * (len(out) + 1) / ranges and (not out or key > out[-1]):
            out.append(key)
    return out


def _range_of(splitters: list[int]):
    """The number of the range that holds a key, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    known = ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in splitters)
    steps = max(1, len(splitters).bit_length())
    found = f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(splitters)}), (s, i) -> if(s.lo >= s.hi, s, if(array({known})[cast((s.lo + s.hi) div 2 as int)] <= key, named_struct('lo', cast((s.lo + s.hi) div 2 as int) + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)))), s -> s.lo)"
    return F.expr(found)


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, sample_keys: int = SAMPLE_KEYS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard and gapless slot of every record."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    records = kept(only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key")))
    total = records.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    groups = records.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    large = groups.filter((F.col("n") > 1) & (F.col("n") * F.col("size") > target * GROUP_SHARE)).collect()  # at most shards / GROUP_SHARE
    cols = ["key", "size", "text_crc32"]
    known = F.broadcast(spark.createDataFrame([(r["key"], r["size"], r["text_crc32"], i) for i, r in enumerate(large)], "key long, size long, text_crc32 long, large int"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(GROUP_PARTS)).cast("int")
    marked = records.join(known, cols, "left")
    rest, hot = marked.filter("large is null").drop("large"), marked.filter("large is not null").withColumn("part", part)

    # Large groups first, the largest into the emptiest shard; one that fits nowhere is cut by rows.
    load, rows_in, cuts = [0.0] * shards, [0] * shards, []
    for i, r in sorted(enumerate(large), key=lambda x: -x[1]["n"] * x[1]["size"]):
        left, at = r["n"], 0
        while left:
            s = min(range(shards), key=lambda k: load[k])
            room = left if load[s] + left * r["size"] <= target else max(1, int((target - load[s]) // r["size"]))
            take = min(left, room)
            cuts.append((i, at, at + take, s, rows_in[s] - at))
            load[s] += take * r["size"]
            rows_in[s] += take
            at, left = at + take, left - take
    outs = []
    if large:
        counts = {(r["large"], r["part"]): r["n"] for r in hot.groupBy("large", "part").agg(F.count("*").alias("n")).collect()}  # at most groups x GROUP_PARTS
        before, rows = {}, []
        for g, p in sorted(counts):
            rows.append((g, p, before.get(g, 0)))
            before[g] = before.get(g, 0) + counts[g, p]
        starts = F.broadcast(spark.createDataFrame(rows, "large int, part int, before long"))
        placed = F.broadcast(spark.createDataFrame(cuts, "large int, from_row long, to_row long, shard int, shift long"))
        w = Window.partitionBy("large", "part").orderBy("doc_id")
        hot = hot.join(starts, ["large", "part"]).withColumn("row", F.col("before") + F.row_number().over(w) - 1)
        hot = hot.join(placed, "large").filter("row >= from_row and row < to_row")
        outs.append(hot.select("doc_id", "size", "text_crc32", "shard", (F.col("row") + F.col("shift")).alias("slot")))

    # The others by ranges of the key.
    ranges = int(min(MAX_RANGES, max(MIN_RANGES, total // range_bytes)))
    splitters = _splitters(rest, max(total, 1), ranges, max(sample_keys, 8 * ranges))
    wide = 2 * max(1.0, (total - sum(load)) / max(1, len(splitters) + 1))
    while True:
        ranged = rest.withColumn("range", _range_of(splitters))
        sizes = {r["range"]: r for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        more = sorted({r["low"] + (r["high"] - r["low"]) * j // k for r in sizes.values() if r["bytes"] > wide and r["high"] > r["low"] for k in [min(64, int(r["bytes"] / wide) + 2)] for j in range(1, k)} - set(splitters))
        if not more:
            break
        for x in more:
            bisect.insort(splitters, x)
    starts, so_far, rows = [], 0, 0
    for k in sorted(sizes):
        starts.append((k, so_far, rows))
        so_far, rows = so_far + sizes[k]["bytes"], rows + sizes[k]["n"]
    room = [max(0.0, target - x) for x in load]
    scale, edges, at = so_far / sum(room) if sum(room) else 0.0, [], 0.0
    for x in room[:-1]:
        at += x * scale
        edges.append(at)
    begin = F.broadcast(spark.createDataFrame(starts, "range int, bytes0 long, rows0 long"))
    ordered = Window.partitionBy("range").orderBy("key", "size", "text_crc32", "doc_id")
    running, same = ordered.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("range", "key", "size", "text_crc32")
    rest = ranged.join(begin, "range").withColumn("end", F.col("bytes0") + F.sum("size").over(running)).withColumn("row", F.col("rows0") + F.row_number().over(ordered) - 1)
    middle = (F.min(F.col("end") - F.col("size")).over(same) + F.max("end").over(same)) / 2
    shard = F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda e: e <= F.col("middle"))) if edges else F.lit(0)
    rest = kept(rest.withColumn("middle", middle).withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "shard", "row"))
    firsts = F.broadcast(spark.createDataFrame([(r["shard"], r["first"], rows_in[r["shard"]]) for r in rest.groupBy("shard").agg(F.min("row").alias("first")).collect()], "shard int, first long, taken int"))
    outs.append(rest.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first") + F.col("taken")).alias("slot")))
    out = outs[0]
    for x in outs[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
