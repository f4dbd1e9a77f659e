"""Ranked lexical search: summed accumulators of short lists, then documents in order over long lists, skipping what cannot reach the best k."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bucket_of, cut, gapless

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A list is long if it holds over one in so many documents.
SHORT = 64
#: Documents of a block, of a range within it that is skipped or scored at once, and items of a chunk.
BLOCK_DOCS, RANGE_DOCS, CHUNK_ITEMS = 4096, 128, 256
#: Wanted terms up to which they are sent to every task (about 32 bytes each).
FEW_TERMS = 500_000
#: The term under which a document's number of terms is posted.
LENGTH = ""
_LOWERED = str.maketrans(UPPER, LOWER)


def terms_of(text: str | None) -> list[str]:
    """Terms of a whole text with repeats; null has none."""
    return re.findall(TERM, (text or "").translate(_LOWERED))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (row, id, text): the different terms of each text with their counts, and how many terms there are under LENGTH."""
    for batch in batches:
        rows, terms, counts, sizes = batch.column("row"), [], [], []
        for i in range(batch.num_rows):
            found = Counter(terms_of(batch.column("text")[i].as_py()))
            total = sum(found.values())
            terms += [LENGTH, *found]
            counts += [total, *found.values()]
            sizes += [(len(found) + 1, total)]
            if len(terms) > 100_000 or i == batch.num_rows - 1:
                place = np.repeat(np.arange(i + 1 - len(sizes), i + 1), [n for n, _ in sizes])
                n = np.repeat([t for _, t in sizes], [n for n, _ in sizes])
                yield pa.record_batch([rows.take(pa.array(place)), batch.column("id").take(pa.array(place)), pa.array(n, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["row", "id", "n", "term", "tf"])
                terms, counts, sizes = [], [], []


def postings(docs: DataFrame, wanted: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(row, id, n, term, tf), written, for the terms in ``wanted`` (term: unique) and LENGTH; every row of ``docs`` is a document with a number of its own."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("id"), "text")
    bags = numbered.mapInArrow(_counted, "row long, id long, n long, term string, tf long")
    kept = cut(wanted.union(wanted.sparkSession.createDataFrame([(LENGTH,)], "term string")), "wanted")
    few = kept.count() <= FEW_TERMS  # else all terms of all documents are shuffled to meet them
    return cut(bags.join(F.broadcast(kept) if few else kept, "term", "left_semi").select("row", "id", "n", "term", "tf"), "postings")


def best_in_block(frame: pd.DataFrame, k: int, range_docs: int = RANGE_DOCS) -> pd.DataFrame:
    """The k best documents of one block for each item of one chunk: q, row, id, score.

    ``frame`` has rows of four kinds: 0, item ``a`` has the long term ``b`` with weight ``c``; 1, item ``a`` only takes scores from ``c`` on; 2, item ``a`` has
    gathered ``c`` for document ``b`` from short lists; 3, the long term ``a`` gives ``c``, before weighing, to document ``b``. Documents go in the order of their ids.
    What an item has gathered is one more list beside its long ones; a range of documents whose bounds don't reach the floor, or what k documents have already, is skipped.
    """
    kind, a, b, c = (frame[x].to_numpy() for x in ("kind", "a", "b", "c"))
    held = frame.loc[kind >= 2, ["b", "id"]].drop_duplicates().sort_values(["id", "b"], na_position="last")
    order = held["b"].to_numpy()
    if not len(order):
        return pd.DataFrame({"q": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "id": pd.Series(dtype="Int64"), "score": np.zeros(0, np.int64)})
    by_row = np.argsort(order, kind="stable")
    place = lambda rows: by_row[np.searchsorted(order[by_row], rows)]
    starts = np.arange(0, len(order), range_docs)
    terms = np.unique(a[kind == 3])
    given = np.zeros((len(terms), len(order)), np.int32)  # under a million each
    given[np.searchsorted(terms, a[kind == 3]), place(b[kind == 3])] = c[kind == 3]
    most = np.maximum.reduceat(given, starts, axis=1).astype(np.int64) if len(terms) else np.zeros((0, len(starts)), np.int64)
    floors = dict(zip(a[kind == 1], c[kind == 1], strict=True))
    listed = pd.DataFrame({"q": a[kind == 0], "t": b[kind == 0], "w": c[kind == 0]})
    listed = {q: (g["t"].to_numpy(), g["w"].to_numpy()) for q, g in listed[listed["t"].isin(terms)].groupby("q")}
    gathered = {q: (g["b"].to_numpy(), g["c"].to_numpy()) for q, g in frame.loc[kind == 2, ["a", "b", "c"]].groupby("a")}
    found = []
    for q, floor in floors.items():
        t, w = listed.get(q, (terms[:0], np.zeros(0, np.int64)))
        at = np.searchsorted(terms, t)
        summed = np.zeros(len(order), np.int64)
        if q in gathered:
            summed[place(gathered[q][0])] = gathered[q][1]
        bound = np.maximum.reduceat(summed, starts) + (w[:, None] * most[at]).sum(axis=0)
        score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(len(starts)):
            if bound[r] < floor or len(score) == k and bound[r] <= score[-1]:
                continue
            part = slice(starts[r], starts[r] + range_docs)
            total = summed[part] + (w[:, None] * given[at, part]).sum(axis=0)
            good = np.flatnonzero(total >= floor)
            score, doc = np.concatenate([score, total[good]]), np.concatenate([doc, starts[r] + good])
            top = np.lexsort((doc, -score))[:k]
            score, doc = score[top], doc[top]
        found.append((np.full(len(doc), q), doc, score))
    q, doc, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame({"q": q.astype(np.int64), "row": order[doc], "id": held["id"].astype("Int64").to_numpy()[doc], "score": score.astype(np.int64)})


def search(docs: DataFrame, items: DataFrame, k: int = 10, short: int = SHORT, block_docs: int = BLOCK_DOCS, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """The k best documents (doc_id, text) of each item (item_id, text) with a score above 0: item_id, rank (from 1), doc_id, score.

    1. Each document's terms are counted in place; those of some item are posted once, with the document's length, in a written table.
    2. Lists of at most one in ``short`` documents are joined with the items' terms and summed by item and document: the accumulators. The k-th of an
       item's is its floor, as scores only grow from there.
    3. Long lists are dealt to blocks of about ``block_docs`` documents, beside the accumulators and a copy of ``chunk_items`` items at a time; a block
       finds its k best documents per item (``best_in_block``), and the best of all blocks are ranked.

    Every row of ``docs`` is a document, so repeated rows are ranked one by one; equal scores go by doc_id, null last. Null and empty texts have no terms and
    are never found. Rows of one item_id, null included, are one item with all their terms. Other columns don't matter. No documents or no items give no rows.
    Blocks are dealt by a hash of the row, so no term, source or group of copies makes one large; joins by term have one side of the size of the items.
    """
    asked = items.select("item_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), 0)).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    asked = cut(asked, "asked")
    ids = cut(asked.select("item_id").distinct(), "ids")
    numbered = cut(gapless(ids, [], ["item_id"], "q", ids.count()), "items")
    lists = postings(docs, asked.select("term").distinct())
    size = lists.filter(F.col("term") == LENGTH).agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.count(F.lit(1))).first()
    n_docs, n_terms, rows = size[0], size[1] or 0, size[2]
    frequent = lists.filter(F.col("term") != LENGTH).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    known = cut(frequent.select("term", weight.alias("w"), (F.col("df") * short > n_docs).alias("long"), F.monotonically_increasing_id().alias("t")), "terms")
    defined = cut(asked.join(known, "term").join(numbered.withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).select("q", (F.col("q") / chunk_items).cast("long").alias("chunk"), "t", "long", (F.col("w") * F.col("times")).alias("weight")), "defined")
    held = lists.filter(F.col("term") != LENGTH).join(known, "term").select("row", "id", "t", "long", F.expr(f"(1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * {n_docs}L) div {max(n_terms, 1)}L))").alias("c"))
    brief = held.filter(~F.col("long")).join(defined.filter(~F.col("long")).select("q", "chunk", "t", "weight"), "t")
    sums = cut(brief.groupBy("q", "chunk", "row", "id").agg(F.sum(F.col("weight") * F.col("c")).alias("c")), "accumulators")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c")))
    floors = sums.select("q", "c").withColumn("_r", nth).filter(F.col("_r") <= k).groupBy("q").agg(F.count(F.lit(1)).alias("_n"), F.min("c").alias("_c"))
    begun = numbered.select("q").join(floors, "q", "left").select((F.col("q") / chunk_items).cast("long").alias("chunk"), F.col("q").alias("a"), F.when(F.col("_n") == k, F.greatest("_c", F.lit(1))).otherwise(F.lit(1)).cast("long").alias("c"))

    blocks = max(1, -(-rows // block_docs))
    block, none = bucket_of(blocks, "row").alias("block"), F.lit(None).cast("long")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    lengthy = defined.filter("long")
    parts = [
        lengthy.select(everywhere, "chunk", F.lit(0).alias("kind"), F.col("q").alias("a"), F.col("t").alias("b"), F.col("weight").alias("c"), none.alias("id")),
        begun.select(everywhere, "chunk", F.lit(1).alias("kind"), "a", F.lit(0).cast("long").alias("b"), "c", none.alias("id")),
        sums.select(block, "chunk", F.lit(2).alias("kind"), F.col("q").alias("a"), F.col("row").alias("b"), "c", "id"),
        held.filter("long").join(lengthy.select("t", "chunk").distinct(), "t").select(block, "chunk", F.lit(3).alias("kind"), F.col("t").alias("a"), F.col("row").alias("b"), "c", "id"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    near = every.groupBy("block", "chunk").applyInPandas(lambda frame: best_in_block(frame, k), "q long, row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row"))
    best = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.join(numbered, "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


#: The search in SQL: every document's score for every item.
SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
size AS (SELECT count(*) AS docs, sum(len(terms)) AS terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, size GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // size.terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), size GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
