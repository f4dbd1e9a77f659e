"""Near copies by overlap: all pairs of texts whose sets of word shingles have a Jaccard similarity from a threshold up.

Two such sets share one of their rarest shingles (prefix filter): under any common order, one of the first n - ceil(t n) + 1. So no pair
is missed, whatever the order; it only decides how many other pairs meet. Here shingles that a sample of the texts has often come last.
Pairs that meet are checked on their whole sets. Each set enters once however many texts have it; texts are known by a fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut, discard

#: Bits of the filter of sets to be checked; members of a bucket whose pairs are made in Spark; members of a block of larger ones; ranges of their outlines there.
BITS, SMALL, BLOCK, COARSE = 22, 8, 1024, 256
#: Bits of a shingle's hash in a posting.
POSTED = 48


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the different word shingles of a whole text, ascending; a text of fewer words is one shingle, one without words has none.

    A shingle's hash mixes those of its words in order.
    """
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(each) - width + 1, 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(width, len(each))):
        mixed = (mixed ^ each[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def set_key(hashes: np.ndarray) -> int | None:
    """A signed 64-bit number that equal sets share; None for no shingle."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).astype(np.int64)) if len(hashes) else None


def prefix(n: int, t: float) -> int:
    return n - math.ceil(t * n - 1e-9) + 1


def often(texts: DataFrame, width: int, sample: int = 5_000, one_in: int = 8, support: int = 4, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``support`` and more of one ``one_in`` texts, ``sample`` at least (by hash of the row number), ascending, and their counts. At most ``most``.

    As many texts are looked at as there are in proportion: under a sample of one size the shingles that it doesn't know grow as common as the table is large.
    """
    total = texts.count()
    sample = max(sample, total // one_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py(), width).astype(np.int64))], names=["h"])

    some = texts.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, sample / max(total, 1)) * (1 << 30))).select("text").mapInArrow(run, "h long")
    rows = some.groupBy("h").count().filter(F.col("count") >= support).orderBy(F.desc("count"), "h").limit(most).toArrow()
    h, n = rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy().astype(np.int64)
    return h[by := np.argsort(h)], n[by]


def buckets(texts: DataFrame, width: int, t: float) -> DataFrame:
    """(h, ms): the sets that have shingle h in their prefix, with size and place, where there are two or more; ``root`` is the key itself.

    A posting is three numbers: the set's key, its size and place, and POSTED bits of the hash; where two shingles agree in these, sets meet
    that need not, and are checked like others. Most shingles occur in one set: those go before anything is collected.
    """
    common, counts = often(texts, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or key in seen:
                    continue
                seen.add(key)
                h = shingles(text.as_py(), width)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
                p = prefix(len(h), t)
                columns = [np.full(p, key), (np.arange(p) << 32) + len(h), (h[:p] >> np.uint64(64 - POSTED)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "place", "h"])

    post = texts.select("key", "text").mapInArrow(run, "key long, place long, h long").repartition("h")
    shared = post.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("_n > 1")
    member = F.struct("key", F.expr("CAST(place & 4294967295 AS int)").alias("n"), F.expr("CAST(shiftright(place, 32) AS int)").alias("at"), F.col("key").alias("root"))
    return cut(shared.groupBy("h").agg(F.collect_set(member).alias("ms")).filter(F.size("ms") > 1), "buckets")


def _may(n: np.ndarray, at: np.ndarray, m: np.ndarray, on: np.ndarray, t: float) -> np.ndarray:
    """Whether sets of n and m that share their shingles at places at and on first can overlap enough."""
    return np.minimum(n - at, m - on) >= np.ceil(t / (1 + t) * (n + m) - 1e-9)


def candidates(groups: DataFrame, t: float, stars: int | None = None) -> DataFrame:
    """Different pairs (a, b) of set keys of different roots. ``stars``: only each member with the first and the last of its bucket, in an order by hash that goes by that number and is one for all buckets; else all of them,
    where members of buckets larger than SMALL have outlines (``outlined``), less those that the outlines rule out: these pairs never become rows."""
    least = f"ceil({t / (1 + t)!r}D * (x.n + y.n) - 1e-9D)"
    meet = F.expr(f"x.key <> y.key AND x.root <> y.root AND least(x.n - x.at, y.n - y.at) >= {least}")
    ends = lambda pairs: pairs.filter(meet).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
    if stars is not None:
        drawn = f"transform(ms, m -> struct(xxhash64(m.key, {stars}) AS o, m.key, m.n, m.at, m.root))"
        few = F.expr(f"array_distinct(array(array_min({drawn}), array_max({drawn})))")
        return cut(ends(groups.select(F.explode("ms").alias("y"), few.alias("few")).select("y", F.explode("few").alias("x"))).distinct(), "candidates")

    def arrays(ms: pa.ListScalar) -> tuple[np.ndarray, ...]:
        return (*(ms.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "n", "at", "root")), coarse(ms.values.field("held").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(*batch.columns, strict=True):
                (a, n, at, r, p), (b, m, on, s, q) = arrays(left), arrays(right)
                first = np.arange(1, len(a) + 1) if same.as_py() else np.zeros(len(a), np.int64)
                found = []
                for i in range(len(a)):
                    k = first[i] + np.flatnonzero((r[i] != s[first[i] :]) & (a[i] != b[first[i] :]) & _may(n[i], at[i], m[first[i] :], on[first[i] :], t))
                    k = k[np.minimum(p[i], q[k]).sum(axis=1) >= t / (1 + t) * (n[i] + m[k]) - 1e-9]
                    found.append((np.minimum(a[i], b[k]), np.maximum(a[i], b[k])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in (0, 1)], names=["a", "b"])

    small = groups.filter(F.size("ms") <= SMALL)
    pairs = ends(small.select(F.explode("ms").alias("x"), "ms").select("x", F.explode("ms").alias("y")).filter("x.key < y.key"))
    # A large bucket is compared block by block, in as many tasks as there are.
    blocks = groups.filter(F.size("ms") > SMALL).withColumn("_e", F.expr(f"CAST((size(ms) - 1) DIV {BLOCK} AS int)"))
    blocks = blocks.withColumn("_i", F.explode(F.expr("sequence(0, _e)"))).withColumn("_j", F.explode(F.expr("sequence(_i, _e)")))
    block = lambda k: F.expr(f"slice(ms, {k} * {BLOCK} + 1, {BLOCK})")
    parts = blocks.select(block("_i").alias("x"), block("_j").alias("y"), (F.col("_i") == F.col("_j")).alias("same"), F.xxhash64("h", "_i", "_j").alias("_d")).repartition("_d").drop("_d")
    return cut(pairs.unionByName(parts.mapInArrow(run, "a long, b long")).distinct(), "candidates")


def outline(hashes: np.ndarray) -> bytes:
    """How many hashes of a set lie in each of some equal ranges of the hash space (a byte each, 255: that or more); about four to eight in one, COARSE ranges at least."""
    bits = max(int(math.log2(COARSE)), math.ceil(math.log2(max(len(hashes), 1) / 8)))
    return np.minimum(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> float:
    """The most hashes that two sets of these outlines can share: in each range the lesser count. Infinite where a count is cut off."""
    p, q = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if (p == 255).any() or (q == 255).any():
        return math.inf
    while len(p) > len(q):
        p = p.reshape(-1, 2).sum(axis=1)
    while len(q) > len(p):
        q = q.reshape(-1, 2).sum(axis=1)
    return float(np.minimum(p, q).sum())


def coarse(outlines: list[bytes]) -> np.ndarray:
    """Outlines as rows of COARSE counts, wider ones summed up; more than any set has where a count is cut off."""
    counts = np.zeros((len(outlines), COARSE), np.int32)
    for row, x in zip(counts, outlines, strict=True):
        each = np.frombuffer(x, np.uint8)
        row[:] = np.iinfo(np.int32).max if (each == 255).any() else each.reshape(COARSE, -1).sum(axis=1, dtype=np.int32)
    return counts


def outlined(groups: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``groups`` with ``held``, the outline of its set, for each member of a bucket larger than SMALL; for others null."""
    size, member = F.size("ms"), ("key", "n", "at", "root")
    flat = groups.filter(size > SMALL).select("h", F.explode("ms").alias("m")).select("h", *(f"m.{c}" for c in member))
    held = sets_of(texts, flat.select("key"), width, True).select("key", "held")
    large = flat.join(held, "key").groupBy("h").agg(F.collect_list(F.struct(*member, "held")).alias("ms"))
    few = groups.filter(size <= SMALL).select("h", F.transform("ms", lambda m: F.struct(*(m[c].alias(c) for c in member), F.lit(None).cast("binary").alias("held"))).alias("ms"))
    return cut(large.unionByName(few), "outlined")


def sets_of(texts: DataFrame, keys: DataFrame, width: int, outlined: bool) -> DataFrame:
    """(key, fp, n, held) of each set that ``keys`` (key) name: its size and its outline or all its hashes. Texts are read again, those of other sets only as far as their key."""
    needed = cut(keys.distinct(), "needed")
    mask = (1 << BITS) - 1
    bits = np.zeros(1 << BITS, bool)
    bits[[r[0] for r in needed.select(F.col("key").bitwiseAND(F.lit(mask)).cast("int").alias("k")).distinct().collect()]] = True
    packed = np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.unpackbits(np.frombuffer(packed, np.uint8)), set()
        for batch in batches:
            for fp, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key is not None and wanted[key & mask] and key not in seen:
                    seen.add(key)
                    h = shingles(text.as_py(), width)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([fp]), pa.array([len(h)]), pa.array([outline(h) if outlined else h.tobytes()], pa.binary())], names=["key", "fp", "n", "held"])

    sets = texts.select("fp", "key", "text").mapInArrow(run, "key long, fp long, n long, held binary").join(needed, "key", "left_semi")
    return cut(sets.groupBy("key").agg(F.min_by("held", "fp").alias("held"), F.min("n").alias("n"), F.min("fp").alias("fp")), "sets")


def checked(texts: DataFrame, pairs: DataFrame, width: int, t: float) -> DataFrame:
    """(a, b) fingerprints of the pairs whose whole sets are similar. Pairs whose outlines rule that out go first, so that few carry whole sets."""

    @F.arrow_udf("boolean")
    def may_be(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        total = np.asarray(n) + np.asarray(m)
        return pa.array([most_shared(p.as_py(), q.as_py()) >= t / (1 + t) * k - 1e-9 for p, q, k in zip(x, y, total, strict=True)], pa.bool_())

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= t * (len(p) + len(q) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    def met(some: DataFrame, sets: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("key").alias(k), F.col("held").alias(f"h{k}"), F.col("n").alias(f"n{k}"), F.col("fp").alias(f"f{k}")) for k in ("a", "b"))
        return some.join(one, "a").join(two, "b")

    ends = lambda some: some.select("a").union(some.select("b")).toDF("key")
    outlines = sets_of(texts, ends(pairs), width, True)
    near = cut(met(pairs, outlines).filter(may_be("ha", "hb", "na", "nb")).select("a", "b"), "near")
    whole = sets_of(texts, ends(near), width, False)
    out = cut(met(near, whole).filter(similar("ha", "hb")).select(F.col("fa").alias("a"), F.col("fb").alias("b")), "similar")
    discard(outlines, near, whole)
    return out


def equal_sets(texts: DataFrame) -> DataFrame:
    """(a, b) fingerprints of texts with the same set."""
    seen = texts.filter(F.col("key").isNotNull()).select("key", "fp").distinct()
    return seen.join(seen.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("_z")).filter("a < _z"), "key").filter("fp > a").select("a", F.col("fp").alias("b"))


def rerooted(groups: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """``groups`` with the roots (node, root) of their members' fingerprints in place of their keys, without those of one root."""
    flat = groups.select("h", F.explode("ms").alias("m")).select("h", "m.key", "m.n", "m.at")
    of = texts.groupBy("key").agg(F.min("fp").alias("node")).join(roots, "node").select("key", "root")
    member = F.struct("key", "n", "at", "root")
    with_root = flat.join(of, "key", "left").withColumn("root", F.coalesce("root", "key"))
    again = with_root.groupBy("h").agg(F.collect_list(member).alias("ms"), F.min("root").alias("_a"), F.max("root").alias("_z"))
    return cut(again.filter("_a < _z").select("h", "ms"), "rerooted")
