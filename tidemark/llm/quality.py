"""Quality rules: counts over whole texts and compression bands over whole texts and fixed chunks of them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Bands:
    """Limits of the compressed share of a text's bytes.

    ``low`` and ``high`` are limits at the sizes of ``sizes`` (bytes, ascending), straight lines over the logarithm of the size between: short
    texts compress less, so their limits lie higher. Under ``low`` a text is repetitive, over ``high`` it doesn't compress as language
    does. A text of over ``chunk`` bytes is also rejected if over ``bad_chunks`` of its chunks of ``chunk`` bytes lie outside ``chunk_limits`` (by
    default the limits of that size); the last chunk ends with the text and may overlap the one before, so every byte lies in a judged chunk. A text of up to
    ``chunk`` bytes is a single chunk, which the verdict on the whole text covers. Texts under ``least`` bytes are too short for a verdict and pass.
    The limits given here are wide ones for languages at large; ``fitted`` narrows them to a corpus.
    """

    sizes: tuple[int, ...] = (128, 512, 2048, 8192, 65536)
    low: tuple[float, ...] = (0.45, 0.33, 0.26, 0.22, 0.18)
    high: tuple[float, ...] = (1.10, 0.92, 0.85, 0.82, 0.80)
    chunk: int = 4096
    bad_chunks: float = 0.34
    least: int = 128
    level: int = 3
    chunk_limits: tuple[float, float] | None = None

    def limits(self, size: int) -> tuple[float, float]:
        at = np.log(np.asarray(self.sizes, float))
        return float(np.interp(np.log(max(size, 1)), at, self.low)), float(np.interp(np.log(max(size, 1)), at, self.high))

    def of_chunk(self) -> tuple[float, float]:
        return self.chunk_limits or self.limits(self.chunk)


def _line(size: Column, sizes: tuple[int, ...], values: tuple[float, ...]) -> Column:
    """``values`` at ``sizes``, straight lines over the logarithm of ``size`` between, level outside."""
    x, out = F.log(F.greatest(size, F.lit(1)).cast("double")), F.lit(values[-1])
    for i in range(len(sizes) - 1, 0, -1):
        a, b = math.log(sizes[i - 1]), math.log(sizes[i])
        out = F.when(x < b, F.lit(values[i - 1]) + (x - a) / (b - a) * (values[i] - values[i - 1])).otherwise(out)
    return F.when(x < math.log(sizes[0]), values[0]).otherwise(out)


def fence(counts: list[tuple[float, int]], reach: float, narrowest: float) -> tuple[float, float]:
    """Limits ``reach`` times the distance of the quartiles outside them; that distance counts as ``narrowest`` of the median at least."""
    counts = sorted(counts)
    upto = np.cumsum([n for _, n in counts])
    q1, mid, q3 = (counts[int(np.searchsorted(upto, p * upto[-1]))][0] for p in (0.25, 0.5, 0.75))
    far = reach * max(q3 - q1, narrowest * mid)
    return q1 - far, q3 + far


def fitted(measured: DataFrame, bands: Bands, support: int = 30, reach: float = 3.0, narrowest: float = 0.03) -> Bands:
    """``bands`` narrowed to a corpus: limits by length class from the quartiles of all its texts, none left out.

    ``measured`` is what ``measures`` makes. A class is the texts of 2^k to 2^(k+1) bytes that pass the base rule; those of equal size and share count once,
    so a large group of copies doesn't set the limits. A class of fewer than ``support`` keeps the limits of ``bands``, as do chunks where they are
    fewer. The driver gets a count per class and thousandth of the share, some ten thousand rows at most.
    """
    passing = measured.filter(~F.col("base_failed") & (F.col("n_bytes") >= bands.least))
    share = lambda c: F.round(c, 3).alias("share")
    whole = passing.select("n_bytes", "ratio").distinct().select(F.floor(F.log2(F.col("n_bytes").cast("double")) + 1e-9).cast("int").alias("k"), share(F.col("ratio")))
    parts = passing.select("n_bytes", F.explode("shares").alias("s")).distinct().select(F.lit(-1).alias("k"), share(F.col("s")))
    of: dict[int, list[tuple[float, int]]] = {}
    for r in whole.unionByName(parts).groupBy("k", "share").count().collect():
        of.setdefault(r["k"], []).append((r["share"], r["count"]))
    own = {k: fence(c, reach, narrowest) for k, c in of.items() if sum(n for _, n in c) >= support}
    chunk = own.pop(-1, None)
    middles = {round(2 ** (k + 0.5)): limits for k, limits in own.items()}
    if middles:
        fixed = {s: bands.limits(s) for s in bands.sizes if not min(middles) / 2 < s < 2 * max(middles)}
        middles |= fixed
        sizes = tuple(sorted(middles))
        bands = replace(bands, sizes=sizes, low=tuple(middles[s][0] for s in sizes), high=tuple(middles[s][1] for s in sizes), chunk_limits=bands.of_chunk())
    return replace(bands, chunk_limits=chunk) if chunk else bands


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(index) == n:
        return 0
    ids = np.array([index[w] for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice, covered = counts[which] > 1, np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, bands: Bands) -> DataFrame:
    """Counts and compressed shares of every row of ``docs`` (doc_id, text): those that ``rules`` returns, and ``shares`` of a long text's chunks. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False).compress

        def of(text: str | None) -> tuple:
            text = text or ""
            raw = text.encode()
            words = raw.split()
            n, repeats = len(words), repeated_words(words)
            starts = [*range(0, len(raw) - bands.chunk, bands.chunk), len(raw) - bands.chunk] if len(raw) > bands.chunk else []
            shares = [len(squeeze(raw[i : i + bands.chunk])) / bands.chunk for i in starts]
            ratio = len(squeeze(raw)) / len(raw) if raw else None
            return n, len(text) - sum(map(text.count, BLANK)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats, len(raw), ratio, shares, n < 50 or 100 * repeats > 50 * n

        kinds = [pa.int64()] * 6 + [pa.float64(), pa.list_(pa.float64()), pa.bool_()]
        for batch in batches:
            columns = zip(*(of(t.as_py()) for t in batch.column(1)), strict=True) if batch.num_rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, shares array<double>, base_failed boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def rules(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bytes, ratio (compressed share, null for empty
    texts), n_chunks, bad_chunks (counts), base_failed, kept. Without ``bands``, limits are fitted to the texts of ``docs`` themselves: they are
    measured once, the measures written, and judged when all are known. A null or empty text has no words and fails the base rule. Repeated
    rows each get their row. Very long texts are read whole; other columns, whatever their names, are left out; an empty table gives none.
    """
    measured = measures(docs, bands or Bands())
    if bands is None:
        measured = cut(measured, "measures")
        bands = fitted(measured, Bands())
    low, high = (_line(F.col("n_bytes"), bands.sizes, v) for v in (bands.low, bands.high))
    chunk_low, chunk_high = bands.of_chunk()
    bad = F.size(F.filter("shares", lambda s: ~s.between(chunk_low, chunk_high))).cast("long")
    judged = measured.withColumn("n_chunks", F.size("shares").cast("long")).withColumn("bad_chunks", bad)
    fits = (F.col("n_bytes") < bands.least) | F.col("ratio").between(low, high)
    fits = fits & (F.col("bad_chunks") <= F.col("n_chunks") * bands.bad_chunks)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(True))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "ratio", "n_chunks", "bad_chunks", "base_failed", "kept"
    )
