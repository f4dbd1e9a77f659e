"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a code word; one binary classifier per bit says from n-gram counts whether the bit is set. A text gets the
language whose code word costs least under a logistic loss weighted by each classifier's margin; a small lead over the runner-up marks
the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sampled

UNDETERMINED = "und"
#: Feature slots: byte pairs directly, byte triples and quadruples by hash.
PAIRS, HASHED = 1 << 16, 1 << 16
SLOTS = PAIRS + 2 * HASHED


def ngram_slots(raw: bytes) -> np.ndarray:
    """Slots of all byte 2-, 3- and 4-grams of a text between two spaces, ASCII letters lowered and digits as one."""
    b = np.frombuffer(b" " + raw.lower().translate(_DIGITS) + b" ", np.uint8).astype(np.uint32)
    two = (b[:-1] << 8) | b[1:]
    three = (((two[:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    four = (((two[:-2] << 16) | two[2:]) * np.uint32(2246822519)) >> np.uint32(16)
    return np.concatenate([two, three + np.uint32(PAIRS), four + np.uint32(PAIRS + HASHED)])


_DIGITS = bytes(48 if 48 <= i < 58 else i for i in range(256))


def code_words(k: int, seed: int = 7) -> np.ndarray:
    """k code words of -1 and 1, far apart: all splits of the languages for up to 7 of them, else the best of seeded random codes."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 7:
        splits = [(0, *rest) for rest in itertools.product((0, 1), repeat=k - 1) if any(rest)]
        return np.asarray(splits).T * 2.0 - 1
    bits, rng, best, apart = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        near = min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(k), 2)) if k <= 64 else int(((bits - code @ code.T)[~np.eye(k, dtype=bool)] / 2).min())
        if near > apart and (np.abs(code.sum(axis=0)) < k).all():
            best, apart = code, near
    return best


@dataclass(frozen=True)
class Model:
    """``weights`` (slots x bits): a text's margin of a bit is the mean weight of its n-grams."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    sharpness: float = 8.0

    def margins(self, raw: bytes, step: int = 1 << 18) -> np.ndarray:
        """Mean weight per bit over the whole text, taken in runs that overlap by an n-gram."""
        total, n = np.zeros(self.weights.shape[1]), 0
        for at in range(0, max(len(raw), 1), step):
            slots = ngram_slots(raw[at : at + step + 2])
            total += self.weights[slots].sum(axis=0, dtype=np.float64)
            n += len(slots)
        return total / n

    def decode(self, raw: bytes) -> tuple[str, float]:
        """The language, and its share of the weights that the losses leave to all languages (0 to 1)."""
        z = self.code * self.margins(raw)[None, :] * self.sharpness
        loss = np.logaddexp(0, -z).mean(axis=1) * z.shape[1]
        rest = np.exp(loss.min() - loss)
        return self.languages[int(np.argmin(loss))], float(rest.max() / rest.sum())


def language_counts(docs: DataFrame, known: str = "lang") -> DataFrame:
    """(lang, slot, n): n-gram counts of all texts by language, summed in each task first; at most languages x SLOTS rows, however many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                at = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                for i in range(0, max(len(raw), 1), 1 << 20):
                    at += np.bincount(ngram_slots(raw[i : i + (1 << 20) + 2]), minlength=SLOTS)
        for lang, counts in sums.items():
            slots = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(counts[slots], pa.int64())], names=["lang", "slot", "n"])

    told = docs.filter(F.col(known).isNotNull() & F.col("text").isNotNull()).select(F.col(known).alias("lang"), "text").mapInArrow(run, "lang string, slot int, n long")
    return told.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = 20_000) -> Model:
    """Fit on labelled rows (``lang``, ``text``); of more than ``sample`` rows, the whole texts of about as many, by a hash of text and row number.

    The bound is on the fit alone; it keeps its cost from growing with the corpus. Per bit, naive Bayes weighs the n-grams of the
    languages whose bit is set, each language counting alike, against the others. Rows without ``lang`` or text teach nothing; very long
    texts are counted whole; repeated rows count each time, and repeated and null doc_ids are sampled like others; other columns are ignored; without any
    labelled row the model knows only ``und``.
    """
    labelled = docs.filter(F.col("lang").isNotNull())
    labelled = sampled(labelled.select("lang", "text", F.monotonically_increasing_id().alias("row")), sample)
    packed = F.collect_list(F.struct("slot", "n"))  # SLOTS at most
    merged = language_counts(labelled).groupBy("lang").agg(packed.alias("c")).select("lang", F.col("c.slot").alias("slot"), F.col("c.n").alias("n"))
    rows = []
    for r in sorted(merged.collect(), key=lambda r: r["lang"]):
        counts = np.zeros(SLOTS)
        counts[r["slot"]] = r["n"]
        rows.append((r["lang"], counts))
    if not rows:
        return Model((UNDETERMINED,), np.ones((1, 1)), np.zeros((SLOTS, 1), np.float32))
    share = []
    for _, counts in rows:
        parts = [counts[:PAIRS], counts[PAIRS : PAIRS + HASHED], counts[PAIRS + HASHED :]]
        share.append(np.concatenate([(p + 0.5) / (p.sum() + 0.5 * np.count_nonzero(p) + 1) for p in parts]))
    shares, code = np.asarray(share), code_words(len(rows))
    weights = np.zeros((SLOTS, code.shape[1]))
    for bit in range(code.shape[1]):
        on = code[:, bit] > 0
        if on.all() or not on.any():
            continue
        weights[:, bit] = np.log(shares[on].mean(axis=0)) - np.log(shares[~on].mean(axis=0))
    return Model(tuple(x for x, _ in rows), code, np.clip(weights, -6, 6).astype(np.float32))


def with_language(docs: DataFrame, model: Model, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` (lang_pred, score) from the whole text alone.

    A null or empty text, or one without a letter, is ``und`` with score 0. Of languages that cost alike the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.code, model.weights, model.sharpness))  # slots x bits: a fixed size

    @F.arrow_udf("lang_pred string, score double")
    def decode(text: pa.Array, letters: pa.Array) -> pa.Array:
        m = Model(*shared.value)
        found = [m.decode(t.as_py().encode()) if has else (UNDETERMINED, 0.0) for t, has in zip(text, letters.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(out, decode("text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))


def predict(docs: DataFrame, model: Model, unsure: float = 0.6) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous (score under ``unsure``) for every row.

    Very long texts are read whole, in steps; repeated rows get equal answers; other columns, whatever their names, are left out; an empty table gives none.
    """
    out = with_language(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, "_l")
    return out.select("doc_id", "_l.lang_pred", "_l.score").withColumn("ambiguous", F.col("score") < unsure)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Rows kept from training: CRC-32 of doc_id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict all. Columns: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
