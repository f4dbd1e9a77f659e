"""Best-fit packing of documents into fixed-length token sequences by non-negative least squares over length patterns.

The only thing planned outside Spark's tasks is the length histogram, which has at most ``capacity`` rows whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fresh, gapless

PIECE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
#: The pre-tokenizer's pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, equal to those of the ``tokenizers`` file at ``path``.

    ``tiktoken`` runs the ranks of that file several times as fast, where the file is a plain byte-level vocabulary; any other file, and a
    text that holds an added token's string, goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        spec = json.loads(self.tokenizer.to_str())
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        unusual = [spec.get("normalizer"), before.get("add_prefix_space"), *(model.get(x) for x in ("ignore_merges", "dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))]
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any(unusual)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if not plain:
            return
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in self.added}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokens of every whole document, then ``end_id``; documents over ``capacity`` tokens are cut so that all pieces but the first are full.

    A null text counts as empty (one piece: the end id). Rows of equal doc_id are separate documents. Columns: doc_id, piece,
    start, length, ids (little-endian unsigned 32-bit).
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = enc.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n, capacity), n]
                    rows += [(doc_id, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=PIECE.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, PIECE)


@dataclass
class Plan:
    """Where the r-th piece of a length goes: sequence ``first + (r - rank) // each``, offset ``base + (r - rank) % each * length``."""

    capacity: int
    sequences: int = 0
    placed: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, rank, first, each, base
    used: dict[int, int] = field(default_factory=dict)

    def put(self, length: int, n: int, first: int, each: int, base: int) -> None:
        rank = self.used.get(length, 0)
        self.placed.append((length, rank, first, each, base))
        self.used[length] = rank + n


def nonnegative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Least squares with no negative coefficient: columns enter by largest gradient and leave at zero."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[free] = 0
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        free[j] = True
        while True:
            fit = np.zeros_like(x)
            fit[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (fit[free] > 0).all():
                x = fit
                break
            bad = free & (fit <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - fit[bad], 1e-300))
            x = np.maximum(x + step * (fit - x), 0)
            x[bad & (x <= 1e-12)] = 0
            free &= x > 0
            if not free.any():
                break
    return x


def patterns(classes: int) -> list[tuple[int, ...]]:
    """All ways of one to three length classes (largest first) that fill a sequence of ``classes`` classes."""
    two = [(a, classes - a) for a in range(classes - 1, 0, -1) if a >= classes - a]
    three = [(a, b, classes - a - b) for a in range(classes - 2, 0, -1) for b in range(min(a, classes - a - 1), 0, -1) if b >= classes - a - b]
    return [(classes,), *two, *three]


def plan_packing(histogram: dict[int, int], capacity: int = 2048, classes: int = 64) -> Plan:
    """Fit how often each pattern repeats, round down, lay as many of those sequences as come out full, then best-fit what is left, longest first, into the fullest that takes it.

    The work depends on the number of different lengths, never on the number of pieces: equal sequences are handled as one range.
    """
    plan, width = Plan(capacity), -(-capacity // classes)
    left = {length: n for length, n in sorted(histogram.items(), reverse=True) if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError("lengths must be 1 to capacity")
    of = lambda length: -(-length // width)
    by_class: dict[int, list[int]] = {}
    for length in left:
        by_class.setdefault(of(length), []).append(length)
    kinds = patterns(of(capacity))
    a = np.zeros((of(capacity), len(kinds)))
    for j, kind in enumerate(kinds):
        for c in kind:
            a[c - 1, j] += 1
    b = np.asarray([sum(left[x] for x in by_class.get(c + 1, [])) for c in range(of(capacity))], float)
    weight = np.sqrt(np.arange(1, of(capacity) + 1))[:, None]  # long pieces are the hard ones to place later
    repeats = np.floor(nonnegative_fit(a * weight, b * weight[:, 0]) + 1e-9).astype(int)
    open_at: dict[int, list[tuple[int, int]]] = {}  # space left: ranges (first, n)

    def pick(kind: tuple[int, ...]) -> list[int]:
        """Lengths that fill a sequence to the last token: by class all but the last, which is whatever is missing."""
        heads = [[x] for x in by_class.get(kind[0], []) if left[x]]
        if len(kind) == 3:
            heads = [[*h, x] for h in heads for x in by_class.get(kind[1], []) if left[x] > h.count(x)]
        for got in heads if len(kind) > 1 else ():
            last = capacity - sum(got)
            if left.get(last, 0) > got.count(last):
                return [*got, last]
        return [capacity] if len(kind) == 1 and left.get(capacity) else []

    for j in np.argsort(-np.asarray([max(k) for k in kinds]), kind="stable"):
        todo = int(repeats[j])
        while todo and (got := pick(kinds[j])):
            n, base = min(todo, *(left[x] // got.count(x) for x in got)), 0
            for x in got:
                plan.put(x, n, plan.sequences, 1, base)
                left[x] -= n
                base += x
            plan.sequences += n
            todo -= n
    spaces = np.zeros(capacity + 1, bool)

    def leave(space: int, first: int, n: int) -> None:
        if space and n:
            open_at.setdefault(space, []).append((first, n))
            spaces[space] = True

    for length, n in left.items():
        while n:
            fits = np.flatnonzero(spaces[length:])
            space = length + int(fits[0]) if len(fits) else capacity
            each = space // length
            if len(fits):
                first, have = open_at[space].pop()
                if not open_at[space]:
                    spaces[space] = False
            else:
                first, have = plan.sequences, -(-n // each)
                plan.sequences += have
            full = min(have, n // each)
            rest = min(n - full * each, each - 1) if full < have else 0
            plan.put(length, full * each + rest, first, each, capacity - space)
            n -= full * each + rest
            leave(space - each * length, first, full)
            if rest:
                leave(space - rest * length, first + full, 1)
            leave(space, first + full + bool(rest), have - full - bool(rest))
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (doc_id, piece, start, length and any others), read several times: pass a written table.

    Pieces of one length are interchangeable, so each only needs its number among those of its length; lengths are few, and a hot
    one is numbered over many tasks.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_packing(histogram, capacity)
    placed = np.asarray(sorted(plan.placed) or [(0, 0, 0, 1, 0)], np.int64)
    key = (placed[:, 0] << 44) + placed[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        row = placed[np.searchsorted(key, (n << 44) + r, "right") - 1]
        i = r - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 2] + i // row[:, 3], "offset": row[:, 4] + i % row[:, 3] * n})

    rank, at = fresh(pieces, "_rank"), fresh(pieces, "_at")
    ranked = gapless(pieces, ["length"], ["doc_id", "piece", "start"], rank, max(histogram.values(), default=0), len(histogram))
    return ranked.withColumn(at, place("length", rank)).select(*pieces.columns, f"{at}.sequence_id", f"{at}.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence (at most ``capacity``), from packed pieces that still hold ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    hexed = F.array_join(F.transform(parts, lambda p: F.hex(p["ids"])), "")
    return packed.groupBy("sequence_id").agg(F.unhex(hexed).alias("ids"), F.transform(parts, lambda p: p["offset"]).alias("offsets"))


def packed_digest(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pack whole documents; per piece its place and the CRC-32 of its ids. The ids themselves are dropped before the first shuffle."""
    digest = token_pieces(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(cut(digest, "pieces"), capacity)
