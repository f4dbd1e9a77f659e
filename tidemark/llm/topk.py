"""Exact top-k inner products: document-range blocks are taken by the sum of their per-dimension maxima for each query, and scored through
the block's own vectors until no block left can reach the k-th score. Only blocks that can reach it leave their place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut


def whole_vectors(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): integer vectors floor(scale * x). Rows with a null id, a null vector, or a null or non-finite component are left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("long")).alias("v"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Consecutive rows by vec_id in blocks: block, n, width, ids, rows (row-major), high and low (per dimension). Shorter vectors are padded with zeros."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in range(0, len(ids), size):
                part, width = vs[at : at + size], max(map(len, vs[at : at + size]))
                rows = np.array([v + [0] * (width - len(v)) for v in part], np.int64).reshape(len(part), width)
                high, low = (f(axis=0) if width else rows[0] for f in (rows.max, rows.min))
                values = [len(part), width, ids[at : at + size].astype("<i8").tobytes(), rows.tobytes(), high.tobytes(), low.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["n", "width", "ids", "rows", "high", "low"])

    packed = vectors.sortWithinPartitions("vec_id").mapInArrow(pack, "n int, width int, ids binary, rows binary, high binary, low binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


def _matrix(frame: pd.DataFrame, column: str, width: int) -> np.ndarray:
    """The vectors of a column of blocks, padded to one width."""
    return np.vstack([np.pad(np.frombuffer(x, np.int64).reshape(-1, w) if w else np.zeros((n if column == "rows" else 1, 0), np.int64), ((0, 0), (0, width - w))) for x, w, n in zip(frame[column], frame["width"], frame["n"], strict=True)])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in doubles as long as they are exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if largest < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(blocks: pd.DataFrame, queries: pd.DataFrame) -> np.ndarray:
    """Queries x blocks: the most that a vector of a block can score, from the block's maxima and minima of each dimension."""
    width = int(max(blocks["width"].max(), queries["width"].max()))
    q = _matrix(queries, "rows", width)
    return _product(np.maximum(q, 0), _matrix(blocks, "high", width)) + _product(np.minimum(q, 0), _matrix(blocks, "low", width))


def _ids(frame: pd.DataFrame, column: str = "ids") -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.int64) for x in frame[column]])


def best_in_group(blocks: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates in ``blocks`` of each query, ties to smaller ids, as far as they reach the query's ``floor`` (where there is one).

    Blocks are scored in the order of their bounds, until these fall below the k-th score or the floor.
    """
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if blocks.empty or queries.empty:
        return empty
    width = int(max(blocks["width"].max(), queries["width"].max()))
    q, q_ids, bound = _matrix(queries, "rows", width), _ids(queries), bounds(blocks, queries)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows = [_matrix(blocks.iloc[[b]], "rows", width) for b in range(len(blocks))]
    ids = [np.frombuffer(x, np.int64) for x in blocks["ids"]]
    least = np.iinfo(np.int64).min
    floor = _ids(queries, "floor") if "floor" in queries else np.full(len(q), least)
    scores, found = np.full((len(q), k), least), np.full((len(q), k), np.iinfo(np.int64).max)
    for turn in range(len(blocks)):
        block = order[:, turn]
        active = np.flatnonzero(bound[np.arange(len(q)), block] >= np.maximum(scores[:, -1], floor))
        if not len(active):
            break
        for b in np.unique(block[active]):
            who = active[block[active] == b]
            s = np.hstack([scores[who], np.where(ids[b][None, :] == q_ids[who, None], least, _product(q[who], rows[b]))])
            v = np.hstack([found[who], np.broadcast_to(ids[b], (len(who), len(ids[b])))])
            v = np.where(s == least, np.iinfo(np.int64).max, v)
            top = np.lexsort((v, -s.astype(np.float64)), axis=1)[:, :k] if np.abs(s[s > least]).max(initial=0) < 2**52 else np.array([sorted(range(s.shape[1]), key=lambda i, r=r: (-int(s[r, i]), v[r, i]))[:k] for r in range(len(who))])
            scores[who], found[who] = np.take_along_axis(s, top, 1), np.take_along_axis(v, top, 1)
    real = scores > least
    return pd.DataFrame({"query_id": np.repeat(q_ids, k)[real.ravel()], "vec_id": found[real], "score": scores[real]})


def _range_of(block: Column, size: int) -> Column:
    """Number of the run of ``size`` consecutive blocks that a block lies in (its number is partition and place)."""
    return F.shiftright(block, 33) * F.lit(1 << 31) + F.floor(block.bitwiseAND(F.lit((1 << 33) - 1)) / size)


def search(vectors: DataFrame, is_query: Column, k: int = 10, block_rows: int = 256, group_blocks: int = 16, bound_blocks: int = 4096, query_rows: int = 256, query_chunk: int = 8, seed_queries: int = 4096) -> DataFrame:
    """The k highest scores of each query row against every other row: query_id, rank (from 1), vec_id, score.

    1. Bounds alone (``bound_blocks`` blocks' maxima and minima meet a chunk of queries) give each query its best block.
    2. The k-th score in that block is the query's floor. A block that many queries begin with is copied for each ``seed_queries`` of them.
    3. Bounds again: a block goes to a chunk of queries only if its bound reaches the floor of one of them.
    4. Runs of ``group_blocks`` neighbours are scored for a chunk, each query taking blocks in the order of bounds; the best are merged.

    A row never answers its own vec_id; rows that share a vec_id are each a candidate, and each a query whose answers can't be told
    apart: such ids get the k best of all their rows' answers. No rows give none; other columns are ignored; tasks have a bounded size.
    """
    number = F.col("block")

    def packed_by_range(rows: DataFrame, size: int, per_task: int) -> DataFrame:
        tasks = max(1, -(-rows.count() // (size * per_task)))  # a run of blocks never spans two of them, so they should be full
        return blocks(rows.repartitionByRange(tasks, "vec_id"), size)

    packed = cut(packed_by_range(vectors, block_rows, max(64, group_blocks)), "blocks")
    chunks = cut(packed_by_range(vectors.filter(is_query), query_rows, query_chunk).withColumn("c", _range_of(number, query_chunk)), "queries")
    n_chunks = [r[0] for r in chunks.select("c").distinct().collect()]  # one per query_rows x query_chunk queries
    n_groups = [r[0] for r in packed.select(_range_of(number, bound_blocks)).distinct().collect()]  # one per bound_blocks x block_rows rows
    every = lambda values: F.explode(F.lit(values or [0]))
    outlines = packed.select("block", "width", "n", "high", "low", _range_of(number, bound_blocks).alias("g")).withColumn("c", every(n_chunks))

    def bounded(asked: DataFrame, found: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            a = a.reset_index(drop=True)
            parts = [found(a, b.iloc[[i]], bounds(a, b.iloc[[i]])) for i in range(len(b) if len(a) else 0)]
            return pd.concat(parts) if parts else pd.DataFrame({x.split()[0]: pd.Series(dtype="object") for x in schema.split(", ")})

        return outlines.groupBy("g", "c").cogroup(asked.withColumn("g", every(n_groups)).groupBy("g", "c")).applyInPandas(run, schema)

    def first_block(a: pd.DataFrame, b: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
        best, row = np.argmax(bound, axis=1), b.iloc[0]
        size = int(row["width"]) * 8
        return pd.DataFrame({"asked": row["block"], "place": np.arange(len(bound)), "id": [row["ids"][8 * i : 8 * i + 8] for i in range(len(bound))], "rows": [row["rows"][size * i : size * i + size] for i in range(len(bound))], "width": row["width"], "bound": bound[np.arange(len(bound)), best], "block": a["block"].to_numpy()[best]})

    begins = bounded(chunks, first_block, "asked long, place int, id binary, rows binary, width int, bound long, block long")
    begins = cut(begins.groupBy("asked", "place").agg(F.max_by(F.struct("id", "rows", "width", "block"), F.struct("bound", -F.col("block"))).alias("b")).select("asked", "place", F.col("b.id").alias("ids"), "b.rows", "b.width", "b.block", F.lit(1).alias("n")), "begins")
    copies = cut(begins.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / seed_queries).cast("int").alias("_n")), "copies")
    salted = begins.join(copies, "block").withColumn("s", F.pmod(F.xxhash64("asked", "place"), F.col("_n")).cast("int")).drop("_n")
    first = packed.join(copies, "block").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")

    def floor_of(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or queries.empty:
            return pd.DataFrame({"asked": pd.Series(dtype="int64"), "place": pd.Series(dtype="int32"), "floor": pd.Series(dtype="int64")})
        width = int(max(blocks["width"].max(), queries["width"].max()))
        score = _product(_matrix(queries, "rows", width), _matrix(blocks, "rows", width))
        score[_ids(queries)[:, None] == _ids(blocks)[None, :]] = np.iinfo(np.int64).min
        kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(score), np.iinfo(np.int64).min)
        return pd.DataFrame({"asked": queries["asked"].to_numpy(), "place": queries["place"].to_numpy(), "floor": kth})

    floors = first.groupBy("block", "s").cogroup(salted.groupBy("block", "s")).applyInPandas(floor_of, "asked long, place int, floor long")
    whole = floors.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "floor"))).alias("floors"))  # query_rows of them
    asked = cut(chunks.join(whole.withColumnRenamed("asked", "block"), "block").withColumn("floors", F.col("floors.floor")), "floors")

    def reaching(a: pd.DataFrame, b: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
        near = (bound >= np.asarray(b.iloc[0]["floors"], np.int64)[:, None]).any(axis=0)
        return pd.DataFrame({"block": a["block"].to_numpy()[near], "c": b.iloc[0]["c"]})

    pairs = cut(bounded(asked, reaching, "block long, c long").distinct().withColumn("g", _range_of(number, group_blocks)), "pairs")
    left = pairs.join(packed, "block")
    right = pairs.select(F.col("g").alias("_g"), F.col("c").alias("_c")).distinct().join(asked.drop("block"), F.col("c") == F.col("_c")).withColumn("g", F.col("_g")).drop("_g", "_c")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return best_in_group(a, b.assign(floor=[np.asarray(x, np.int64).tobytes() for x in b["floors"]]), k)

    near = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The search in SQL over ``embeddings``, for queries whose vec_id is divisible by 100.
SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
