"""Spelling variants: words one edit apart, found by full one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

LEAST_LENGTH = 7
RUNS = r"[A-Za-zÀ-ÿ]{%d,}+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Deletions planted by the query: one in so many runs, by the checksum of document and run.
SLIP = 31
#: A form is at least so many times as frequent as the word. Counts are under 2**63, so no chain of forms is longer than 18.
RATIO = 10
SYMBOLS = 3
#: Words of so many code points or more meet by number.
LONG = 64
#: Neighbours that a task makes at a time, if one word has no more.
AT_ONCE = 1 << 20
KEYS = pa.schema([("key", pa.int64()), ("side", pa.bool_()), ("name", pa.string())])
KEY_ROWS = "key long, side boolean, name string"
_WRAP = 1 << 64
_BASE, _BASE_O = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word): the query's words of at least ``least`` code points, with repeats: runs of Latin letters, A-Z lower-cased, some of them short of a letter."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.explode(F.regexp_extract_all("text", F.lit(RUNS % least), 0)).alias("_r")).select("_d", F.translate("_r", UPPER, LOWER).alias("_r"))
    hashed = run.withColumn("_h", F.crc32(F.encode(F.concat("_d", F.lit(":"), "_r"), "UTF-8")))
    at = F.pmod(F.col("_h"), F.length("_r")).cast("int")
    slipped = F.concat(F.substring(F.col("_r"), F.lit(1), at), F.substring(F.col("_r"), at + 2, F.length("_r")))
    word = F.when(F.col("_h") % SLIP == 0, slipped).otherwise(F.col("_r"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times; counts are summed before they are shuffled, so a frequent word is no hot key."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base % _WRAP), np.uint64)]).astype(np.uint64))


class _Spelt:
    """Equally long words as hashes: of every prefix of the reduced word, and of any part of the word itself."""

    def __init__(self, points: np.ndarray, symbols: int) -> None:
        self.n, self.length = points.shape
        self.symbols = symbols
        self.values = _mixed(np.arange(1, symbols + 1, dtype=np.uint64))
        self.reduced = (_mixed(points.astype(np.uint64)) % np.uint64(symbols)).astype(np.int64)
        self.power, inverse = _powers(_BASE, self.length + 1), pow(_BASE, -1, _WRAP)
        self.inverse = np.uint64(inverse)
        zero = np.zeros((self.n, 1), np.uint64)
        self.before = np.concatenate([zero, np.cumsum(self.values[self.reduced] * self.power[: self.length], axis=1, dtype=np.uint64)], axis=1)
        self.own = np.concatenate([zero, np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1 << 32)) * _powers(_BASE_O, self.length - 1), axis=1, dtype=np.uint64)], axis=1)
        self.back = _powers(pow(_BASE_O, -1, _WRAP), self.length)

    @property
    def all(self) -> np.ndarray:
        return self.before[:, -1:]

    def half(self, target: int, front: bool) -> np.ndarray:
        """What a neighbour of length ``target`` has in common with the word if the edit is in the other half."""
        h = target // 2
        if front:
            part = self.own[:, h]
        else:
            start = self.length - (target - h)
            part = (self.own[:, -1] - self.own[:, start]) * self.back[start]
        return _mixed(part + _mixed(np.uint64([2 * target + front])))

    def keyed(self, hashes: np.ndarray, target: int, front: bool) -> np.ndarray:
        return _mixed(hashes ^ self.half(target, front)[:, None])

    def neighbours(self) -> Iterator[tuple[np.ndarray, bool]]:
        """Keys (row by row) and side of all reduced words one edit away; a replacement may leave the reduced word as it is."""
        values, p = self.values, np.arange(self.length + 1)
        for target, kind in ((self.length, "replace"), (self.length - 1, "delete"), (self.length + 1, "insert")):
            for front in (True, False):
                q = p[(p >= target // 2) == front]
                q = q if kind == "insert" else q[q < self.length]
                if not len(q) or target < 1:
                    continue
                at, rest = self.before[:, q], self.all
                if kind == "delete":
                    made = at + (rest - self.before[:, q + 1]) * self.inverse
                elif kind == "insert":
                    made = ((at + (rest - at) * self.power[1])[:, :, None] + values[None, None, :] * self.power[q][None, :, None]).reshape(self.n, -1)
                else:
                    made = (rest[:, :, None] + (values[None, None, :] - values[self.reduced[:, q]][:, :, None]) * self.power[q][None, :, None]).reshape(self.n, -1)
                yield self.keyed(made, target, front), front

    def owns(self) -> Iterator[tuple[np.ndarray, bool]]:
        """The word's own keys, under which neighbours look for it."""
        for front in (True, False):
            yield self.keyed(self.all, self.length, front), front


def _by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of equally long words of an Arrow array, so many at once that their neighbours stay few."""
    text = np.array(words.to_pylist(), dtype=object)
    sizes = np.fromiter((len(t) for t in text), np.int64, len(text))
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        step = max(1, AT_ONCE // (8 * int(size)))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            yield some, np.frombuffer("".join(text[some]).encode("utf-32-le"), np.uint32).reshape(len(some), size)


def _rows(names: pa.Array, places: np.ndarray, keys: np.ndarray, side: bool) -> Iterator[pa.RecordBatch]:
    """A row for each different key of each word."""
    keys = np.sort(keys, axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, key = np.repeat(places, new.sum(axis=1)), keys[new].view(np.int64)
    for i in range(0, len(row), 1 << 16):
        part = row[i : i + (1 << 16)]
        yield pa.record_batch([pa.array(key[i : i + (1 << 16)]), pa.array(np.full(len(part), side)), names.take(pa.array(part)).cast(pa.string())], schema=KEYS)


def neighbourhoods(symbols: int):  # noqa: ANN201
    """For ``mapInArrow`` over (name, text): (key, side, name), the keys of all one-edit neighbours of each reduced text, each once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, points in _by_length(batch.column("text")):
                found: dict[bool, list[np.ndarray]] = {}
                for keys, side in _Spelt(points, symbols).neighbours():
                    found.setdefault(side, []).append(keys)
                for side, parts in found.items():
                    yield from _rows(batch.column("name"), places, np.concatenate(parts, axis=1), side)

    return made


def own_keys(symbols: int):  # noqa: ANN201
    """For ``mapInArrow`` over (name, text): (key, side, name), the two keys of each text itself."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, points in _by_length(batch.column("text")):
                for keys, side in _Spelt(points, symbols).owns():
                    yield from _rows(batch.column("name"), places, keys, side)

    return made


def _pairs(named: DataFrame, symbols: int) -> DataFrame:
    """(word, near, side) of ``named`` (name, text): names of texts that meet under a key."""
    left = named.mapInArrow(neighbourhoods(symbols), KEY_ROWS)
    right = named.mapInArrow(own_keys(symbols), KEY_ROWS).select("key", F.col("side").alias("_side"), F.col("name").alias("near"))
    met = left.join(right.hint("merge"), "key").filter((F.col("side") == F.col("_side")) & (F.col("name") != F.col("near")))
    return met.select(F.col("name").alias("word"), "near", "side")


def _verified(pairs: DataFrame) -> DataFrame:
    """Those of (word, near, side) that are one edit apart. A pair of words that met on both sides counts on one: the first if their first halves are equal."""
    h = F.floor(F.length("near") / 2).cast("int")
    same_front = F.substring(F.col("word"), F.lit(1), h) == F.substring(F.col("near"), F.lit(1), h)
    return pairs.filter((same_front == F.col("side")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near): all ordered pairs of ``words`` (word: unique, at least two code points) that differ by one inserted, deleted or replaced code point, each once.

    1. Letters are hashed to ``symbols`` symbols; every word makes all reduced words one edit away, as hashes.
    2. These meet the hashes of the reduced vocabulary. An edit leaves the half of a word in which it isn't as it was, so the key also has the hash of
       that half of the word itself: words that merely look alike when reduced seldom meet.
    3. Pairs are verified on the words.

    Words of LONG code points or more meet by numbers instead of texts, so that what is shuffled grows with their length and not its square. Nothing is
    broadcast, and rows of a key that many words share are split by Spark's skew join. No words give none.
    """
    size = F.length("word")
    brief = words.filter(size <= LONG).select(F.col("word").alias("name"), F.col("word").alias("text"))
    lengthy = cut(words.filter(size >= LONG).select(F.monotonically_increasing_id().cast("string").alias("name"), F.col("word").alias("text")), "long_words")
    numbers = _pairs(lengthy, symbols).withColumnsRenamed({"word": "_w", "near": "_n"})
    texts = numbers.join(lengthy.select(F.col("name").alias("_w"), F.col("text").alias("word")), "_w").join(lengthy.select(F.col("name").alias("_n"), F.col("text").alias("near")), "_n")
    above = _verified(texts.filter(F.greatest(F.length("word"), F.length("near")) > LONG).select("word", "near", "side"))
    return _verified(_pairs(brief, symbols)).union(above)


def forms(words: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) of ``words`` (word: unique, n): how many words are near, and the near word of largest n (ties: the smallest in code-point order), if that n is at least ``ratio`` times the word's."""
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = near_words(words, symbols).join(counts, "near")
    best = met.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    form_n: Column = -F.col("_best.less")
    enough = form_n >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, form_n).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed`` (word, form, ...) with ``root``, the end of the word's chain of forms. Every round doubles the step, so a chain of 18 takes five joins."""
    at = cut(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        moved = cut(at.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return formed.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, symbols: int = SYMBOLS, ratio: int = RATIO) -> DataFrame:
    """The query's rows: word, form, root, n, n_near, form_n for every word of ``docs`` (doc_id, text) of at least 7 code points that occurs at least twice.

    Null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count again; very long words are words like others; other
    columns don't matter; no rows give none.
    """
    words = cut(vocabulary(runs(docs)), "words")
    formed = cut(forms(words, symbols, ratio), "variants")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")



#: The query in SQL: the checksum by its rule, pairs by deletions on either side.
VARIANTS_SQL = r"""
WITH RECURSIVE tables AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(b AS BIGINT))) AS t
), run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), counted AS (SELECT d, r, count(*) AS times, hex(encode(d || ':' || r)) AS x FROM run WHERE length(r) >= 7 GROUP BY d, r),
hashed AS (
  SELECT r, times, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST(('0x' || x[i:i + 1]) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]), CAST(4294967295 AS BIGINT))) AS h FROM counted, tables
), slipped AS (SELECT CASE WHEN h % 31 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
gone AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gone g JOIN words w ON g.rest = w.word UNION SELECT w.word, g.word FROM gone g JOIN words w ON g.rest = w.word
), ranked AS (
  SELECT p.word, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place FROM pairs p JOIN words v ON v.word = p.near
), formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1
), chain AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.root WHERE e.form IS NULL
"""
