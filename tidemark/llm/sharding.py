"""Sharding by balanced label propagation: linked documents move towards the shard where most of their group is, under quotas.

Documents of one group are interchangeable, so the state is one row per linked group: how many members each shard holds. Each round
every group proposes to move its smaller parts to its largest one (of equal ones, another each round); proposals between two shards are admitted, largest groups first, up to
quotas that keep every shard within its exact capacity. Documents without a link fill what is left, so counts end at most one apart.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import FEW_CELLS, attach, bucket_of, cells, cut, discard, gapless

#: Group key of the documents that have no link.
FREE = 0


def items(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 and key (of equal texts; null texts are equal)."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull(), F.crc32(raw)).alias("key"),
    )


def running_total(df: DataFrame, part: list[str], value: str, by: Column, order: list[str], out: str, few: bool) -> DataFrame:
    """The sum of ``value`` before each row within ``part``, rows ordered by the bucket ``by``, then ``order``; no task needs a whole part. ``few``: the cells (part, bucket) are few enough to broadcast their sums."""
    dealt = df.withColumn("_by", by)
    cell = [*part, "_by"]
    before = Window.partitionBy(*part).orderBy("_by").rowsBetween(Window.unboundedPreceding, -1) if part else Window.orderBy("_by").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*cell).agg(F.sum(value).alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(F.broadcast(starts) if few else starts, cell).withColumn(out, F.col("_start") + within).drop("_by", "_start")


def quotas(wanted: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves between each two shards are admitted: even swaps, exchanges around three shards, then whatever the free places take, in turn."""
    got = {(i, j): min(n, wanted.get((j, i), 0)) for (i, j), n in wanted.items()}
    for i, j in list(wanted):
        for k in range(len(free)):
            ring = [(i, j), (j, k), (k, i)]
            n = min(wanted.get(e, 0) - got.get(e, 0) for e in ring) if len({i, j, k}) == 3 else 0
            for e in ring if n > 0 else ():
                got[e] += n
    free, moved = list(free), True
    while moved:
        moved = False
        for (i, j), n in sorted(wanted.items(), key=lambda x: (got[x[0]] - x[1], x[0])):
            more = min(n - got[i, j], free[j])
            if more > 0:
                got[i, j] += more
                free[j] -= more
                free[i] += more
                moved = True
    return {k: v for k, v in got.items() if v}


def propagate(groups: DataFrame, capacity: list[int]) -> tuple[DataFrame, list[int]]:
    """``have`` (members by shard) of every linked group (key, n, n over 1), and each shard's load.

    The start deals members around the shards, so loads are even; then rounds run until none admits a move. They end, for every move
    goes to a part at least as large, so that the sum of squared parts grows. Only sums by pair of shards reach the driver.
    """
    shards, n_groups = len(capacity), groups.count()
    buckets = cells(n_groups)
    numbered = running_total(groups, [], "n", bucket_of(buckets, "key"), ["key"], "_o", buckets <= FEW_CELLS)

    def dealt(j: int) -> Column:
        first = F.pmod(F.lit(j) - F.col("_o"), F.lit(shards))
        return F.when(first < F.col("n"), F.floor((F.col("n") - 1 - first) / shards) + 1).otherwise(F.lit(0)).cast("long")

    state = cut(numbered.select("key", "n", F.array(*(dealt(j) for j in range(shards))).alias("have")), "groups")
    sums = state.agg(*(F.sum(F.col("have")[j]).alias(f"s{j}") for j in range(shards))).first()
    load = [x or 0 for x in sums]
    room = F.array(*(F.lit(c).cast("long") for c in capacity))
    for turn in itertools.count():
        places = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.struct(F.get("have", j).alias("m"), F.xxhash64("key", j, F.lit(turn)).alias("h"), j.alias("s")))
        spread = state.withColumn("_p", places)

        def wish(p: Column) -> Column:
            better = F.filter("_p", lambda q: (q > p) & (q["m"] < F.get(room, q["s"])))
            return F.struct(p["s"].alias("i"), p["m"].alias("m"), F.array_max(better).alias("to"))

        wishes = F.filter(F.transform(F.filter("_p", lambda p: p["m"] > 0), wish), lambda w: w["to"].isNotNull())
        moves = spread.select("key", F.explode(wishes).alias("w")).select("key", "w.i", F.col("w.to.s").alias("j"), "w.m", F.col("w.to.m").alias("pull"))
        moves = cut(moves, "moves")
        wanted = {(r["i"], r["j"]): r["n"] for r in moves.groupBy("i", "j").agg(F.sum("m").alias("n")).collect()}  # shards x shards
        quota = quotas(wanted, [c - x for c, x in zip(capacity, load, strict=True)])
        if not quota:
            discard(moves)
            return state, load
        spread = cells(n_groups)
        rank = (63 - F.floor(F.log2(F.col("pull") + 1))).cast("long") * spread + bucket_of(spread, "key")
        ranked = running_total(moves, ["i", "j"], "m", rank, ["key", "m"], "_before", 64 * shards * shards * spread <= FEW_CELLS)
        limit = F.coalesce(*(F.when((F.col("i") == i) & (F.col("j") == j), F.lit(q)) for (i, j), q in quota.items()), F.lit(0))
        admitted = ranked.withColumn("_a", F.greatest(F.lit(0), F.least(F.col("m"), limit - F.col("_before")))).filter("_a > 0")
        change = admitted.groupBy("key").agg(F.array(*(F.sum(F.when(F.col("j") == s, F.col("_a")).when(F.col("i") == s, -F.col("_a")).otherwise(0)) for s in range(shards))).alias("_c"))
        joined = state.join(change, "key", "left")
        old, state = state, cut(joined.select("key", "n", F.when(F.col("_c").isNull(), F.col("have")).otherwise(F.zip_with("have", "_c", lambda a, b: a + b)).alias("have")), "groups")
        discard(old, moves)
        for (i, j), q in quota.items():
            load[i] -= q
            load[j] += q
    raise AssertionError  # the rounds end above


def shard_rows(rows: DataFrame, shards: int = 8) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32, key; one row per document, read several times) with ``shard``, ``slot`` (gapless from 0 in its shard) and ``whole`` (all of its group lies there).

    Row counts of any two shards differ by one at most. A group larger than a shard is split over as few as hold it. Repeated rows
    are documents of their own; an empty table gives an empty result.
    """
    n = rows.count()
    capacity = [n // shards + (j < n % shards) for j in range(shards)]
    counts = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "counts")
    state, load = propagate(counts.filter("n > 1"), capacity)
    ends = F.array(*(sum((F.col("have")[i] for i in range(1, j + 1)), F.col("have")[0]) for j in range(shards)))
    whole = F.size(F.filter("have", lambda m: m > 0)) == 1
    known = counts.join(state.select("key", ends.alias("ends"), whole.alias("whole")), "key", "left")
    left = [c - x for c, x in zip(capacity, load, strict=True)]
    free_ends = F.array(*(F.lit(sum(left[: j + 1])).cast("long") for j in range(shards)))
    grouped = attach(rows, known.select("key", "n", "ends", "whole"), "key", "n").withColumn("_g", F.when(F.col("ends").isNull(), F.lit(FREE)).otherwise(F.col("key")))
    tagged = grouped.withColumn("ends", F.coalesce("ends", free_ends)).withColumn("whole", F.coalesce("whole", F.lit(True))).withColumn("_free", F.col("_g") == FREE)
    largest = max(sum(left), counts.agg(F.max("n")).first()[0] or 0)
    ranked = gapless(tagged, ["_g", "_free"], ["doc_id", "text_crc32", "size"], "_r", largest)
    placed = ranked.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_r"))))
    return gapless(placed.select(*rows.columns, "shard", "whole"), ["shard"], ["doc_id", "text_crc32", "size"], "slot", max(capacity), shards)


def cut_edges(placed: DataFrame) -> DataFrame:
    """One row: links (pairs of one key), and how many of them run between shards."""
    dealt = placed.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("m"))
    groups = dealt.groupBy("key").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("kept"))
    return groups.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("links"), F.sum(F.expr("(n * n - kept) div 2")).alias("cut"))


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``), whole (false: its group is split).

    Null texts are equal, and none to an empty one; very long texts count by their bytes; null doc_ids and repeated rows are documents
    like others; other columns, whatever their names, are left out; an empty table gives none.
    """
    placed = shard_rows(cut(items(docs), "items"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "whole")
