"""SimHash near-duplicates with an exact covering: no pair within the threshold is missed, and no anchor ever holds a large group.

Anchors are the words of a perfect covering code on 64 bits: the [63, 57] Hamming code (covering radius 1) on bits 1 to 63, with bit 0
free. Two fingerprints at most ``2 h`` bits apart have a point between them at most ``h`` from each, and that point has an anchor
within the radius; so each fingerprint is sent to every anchor within radius + h of it, 33 anchors for h = 1, and every linked pair
meets at one at least. All fingerprints at one anchor lie within radius + h = 2 bits of it, so at most 2,081 different ones exist
there, whatever the number of documents. Copies share a fingerprint and enter once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import overlap
from tidemark.llm.common import attach, cut, discard, fresh

#: Bits apart at which two fingerprints link, as the covering above is built for it.
THRESHOLD = 2
#: Stars go on while one in so many of their pairs is similar. It changes no result: what isn't linked then meets pair by pair.
WORTH = 20


def _fingerprint(text: str | None, width: int) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at 0x09-0x0D and 0x20
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), 42)
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + width - 1]
        hashes = np.array([digest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(width)), strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row: per bit the majority over the XXH64 hashes of the whole text's word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_signed(f) for f in fps], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _mask(k: int) -> int:
    """Bits 1 to 63 whose position has bit k set, as a signed word."""
    m = sum(1 << i for i in range(1, 64) if i >> k & 1)
    return m - (1 << 64) if m >= 1 << 63 else m


def syndrome(fp: Column) -> Column:
    """The position (1 to 63) whose flip makes bits 1 to 63 a code word; 0 if they are one."""
    parity = [F.bit_count(fp.bitwiseAND(F.lit(_mask(k)))) % 2 for k in range(6)]
    return sum((F.shiftleft(p, k) for k, p in enumerate(parity[1:], 1)), parity[0]).cast("int")


def to_anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp): every fingerprint at each anchor within radius + 1: the nearest with either free bit, and those two flips away."""
    at = fps.select("fp", syndrome(F.col("fp")).alias("_s")).withColumn("_near", F.expr("IF(_s = 0, fp, fp ^ shiftleft(1L, _s))"))
    second = F.expr("IF(_s = 0, CAST(array() AS array<bigint>), transform(filter(sequence(1, 63), i -> i < (i ^ _s) AND i <> _s), i -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, i ^ _s)))")
    return at.select(F.explode(F.concat(F.array("_near", F.expr("_near ^ 1L")), second)).alias("anchor"), "fp")


def _links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A forest that connects what is connected by distances up to THRESHOLD, without listing the pairs."""
    out, left = [], np.sort(fps)
    while len(left):
        grown, left = left[:1], left[1:]
        root = int(grown[0])
        while len(grown) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(grown), 256):
                near |= (np.bitwise_count(grown[at : at + 256, None] ^ left[None, :]) <= THRESHOLD).any(axis=0)
            grown, left = left[near], left[~near]
            out += [(root, int(x)) for x in grown]
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b) pairs of different fingerprints that connect exactly the fingerprints connected by links of at most THRESHOLD bits."""

    @F.pandas_udf("array<struct<a: long, b: long>>")
    def linked(groups: pd.Series) -> pd.Series:
        return pd.Series([_links(np.asarray(g, np.int64)) for g in groups])

    groups = to_anchors(fps).groupBy("anchor").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    two = F.size("fps") == 2
    pair = F.when(F.bit_count(F.expr("fps[0] ^ fps[1]")) <= THRESHOLD, F.array(F.struct(F.array_min("fps").alias("a"), F.array_max("fps").alias("b"))))
    few = groups.filter(two).select(F.explode(pair).alias("l"))
    many = groups.filter(~two).select(F.explode(linked("fps")).alias("l"))
    return few.unionByName(many).select("l.a", "l.b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node of its component.

    Each round takes the least root among a node's neighbours, then follows roots of roots, so chains halve; it ends when nothing changes.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    held = label
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("_m")).withColumnRenamed("a", "node")
        least = label.join(seen, "node").select("node", F.col("root").alias("_old"), F.least("root", "_m").alias("_r"))
        up = label.select(F.col("node").alias("_r"), F.col("root").alias("_up"))
        moved = cut(least.join(up, "_r").select("node", F.least("_r", "_up").alias("root"), (F.least("_r", "_up") < F.col("_old")).alias("_moved")), "roots")
        discard(held)
        held, label = moved, moved.select("node", "root")
        if not moved.filter("_moved").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Class membership of every row of ``docs``: doc_id, fp, component_id (least doc_id reachable over links, itself included).

    A null or empty text has fingerprint 0, as has a text of white space; they link like any other. Repeated rows are kept.
    Null doc_ids take part; a component with null ids alone has component_id null.
    """
    prints = cut(fingerprints(docs, width), "prints")
    own = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "own")
    roots = components(cut(links(own.select("fp")), "links"))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(rooted.join(least, "root").select("fp", "n", "component_id"), "classes")
    return attach(prints, by_print, "fp", "n")


def one_of_each(docs: DataFrame, width: int = 3, overlap_width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each component one row stays, that of the least doc_id (nulls last), of repeated rows of that id one.

    Texts link by fingerprints up to THRESHOLD bits apart, and by a Jaccard similarity of at least ``similarity`` between their sets of
    ``overlap_width``-word shingles; no such pair is missed. Rows are told apart by a number that is written with the table, never by
    doc_id: null and repeated ids take part like any other.
    """
    fp, row, key = fresh(docs, "_fp"), fresh(docs, "_row"), fresh(docs, "_key")

    @F.arrow_udf("fp long, key long")
    def printed(text: pa.Array) -> pa.Array:
        all_ = [t.as_py() for t in text]
        fps, keys = [_signed(_fingerprint(t, width)) for t in all_], [overlap.set_key(overlap.shingles(t, overlap_width)) for t in all_]
        return pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(keys, pa.int64())], names=["fp", "key"])

    keyed = docs.withColumn(fp, printed("text"))
    keyed = cut(keyed.select(*docs.columns, F.col(f"{fp}.fp").alias(fp), F.col(f"{fp}.key").alias(key)).withColumn(row, F.monotonically_increasing_id()), "keyed")
    texts = keyed.select(F.col(fp).alias("fp"), F.col(key).alias("key"), F.col(row).alias("row"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row"))
    own = cut(keyed.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("first")), "own")
    # Stars first: what they link need not meet pair by pair. In a large group of near copies some are not like the star's middle, but like another's; a round that links few of its pairs is the last.
    groups = overlap.buckets(texts, overlap_width, similarity)
    edges = cut(links(own.select("fp")).unionByName(overlap.equal_sets(texts)).filter("a <> b"), "links")
    for step in count():
        pairs = overlap.candidates(groups, similarity, stars=step)
        some = overlap.checked(texts, pairs, overlap_width, similarity).filter("a <> b")
        tried, found = pairs.count(), some.count()
        edges = edges.unionByName(some)
        roots = components(edges)
        groups = overlap.rerooted(groups, texts, roots)
        if found * WORTH < tried or not tried:
            break
    rest = overlap.candidates(overlap.outlined(groups, texts, overlap_width), similarity)
    if rest.limit(1).count():
        more = overlap.checked(texts, rest, overlap_width, similarity).filter("a <> b")
        if more.limit(1).count():
            roots = components(edges.unionByName(more))
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return keyed.join(kept, row, "left_semi").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
