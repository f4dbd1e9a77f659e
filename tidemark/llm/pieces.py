"""SentencePiece segmentations sampled by forward filtering and backward sampling over the piece lattice, and their exact decoding.

Every way to spell a text with pieces is a path of the lattice; a path's weight is the product of its pieces' weights. Forward sums over
paths are computed once for each different run of a batch, then a path is drawn backwards for each occurrence, all occurrences at once. A
run without a space may be as long as the text: long ones take their forward sums in windows that carry the last sums over, and are drawn
backwards window by window. The draws come from a hash of the row's key and the place in the text, so a row's segmentation never depends
on its neighbours, on windows or on retries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces never cross from a word to the spaces after it or over a line feed (a model with such pieces is refused), so these runs segment on their own.
_RUN = re.compile(r" *[^ \n]+| *\n| +")
_PIECE = re.compile(r" *[^ \n]*| *\n")
_SPACE = "▁"
_P, _G = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _scramble(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PieceSampler:
    """``sharpness``: a piece of rank r weighs (r + 2) to the power of minus that, so larger values favour fewer and commoner pieces.

    The model's control and unknown pieces are never used; a character without a piece is spelt in byte pieces, and so is a literal
    U+2581, which pieces write for a space. Thus every text has a path and reads back exactly.
    """

    def __init__(self, path: str, sharpness: float = 1.0, stretch: int = 256, window: int = 1 << 14, slice_chars: int = 300_000):
        import sentencepiece

        self.stretch, self.window, self.slice_chars = stretch, window, slice_chars
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.byte_id = np.full(256, -1, np.int64)
        texts: list[tuple[str, int, float]] = []
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = sp.id_to_piece(i).replace(_SPACE, " ")
                if not _PIECE.fullmatch(text):
                    raise ValueError(f"piece {text!r} crosses from a word to a space or over a line feed")
                self.bytes_of[i] = text.encode()
                texts.append((text, i, -sharpness * float(np.log(2.0 + abs(sp.get_score(i))))))
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        self.byte_weight = -sharpness * float(np.log(2.0 + len(self.bytes_of)))
        self.widest = max(len(t) for t, _, _ in texts)
        hashes = [np.zeros(0, np.uint64)] * (self.widest + 1)
        order = [np.zeros(0, np.int64)] * (self.widest + 1)
        self.score = np.zeros(len(self.bytes_of))
        self.maybe = np.zeros((self.widest + 1, 1 << 16), bool)
        for k in range(1, self.widest + 1):
            mine = [(t, i) for t, i, _ in texts if len(t) == k]
            h = np.zeros(len(mine), np.uint64)
            for j in range(k):
                h = (h + np.array([ord(t[j]) for t, _ in mine], np.uint64) + np.uint64(1)) * _P * _G
            at = np.argsort(h)
            hashes[k], order[k] = h[at], np.array([i for _, i in mine], np.int64)[at] if mine else np.zeros(0, np.int64)
            self.maybe[k, (h >> np.uint64(48)).astype(np.int64)] = True
        for _, i, w in texts:
            self.score[i] = w
        self.hashes, self.order = hashes, order
        self.table = list(self.bytes_of)

    def arcs(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All arcs over the characters of runs laid end to end: start, end, piece (minus 1: byte pieces), weight. ``room``: characters left in the run."""
        starts, ends, pieces = [], [], []  # longest pieces first in the result
        h, one = np.zeros(len(chars), np.uint64), np.zeros(len(chars), bool)
        wide = chars.astype(np.uint64) + np.uint64(1)
        for k in range(1, self.widest + 1):
            live = np.flatnonzero(room >= k)
            if not len(live):
                break
            h[live] = (h[live] + wide[live + k - 1]) * _P * _G
            live = live[self.maybe[k, (h[live] >> np.uint64(48)).astype(np.int64)]]
            if not len(live):
                continue
            at = np.minimum(np.searchsorted(self.hashes[k], h[live]), len(self.hashes[k]) - 1)
            hit = self.hashes[k][at] == h[live]
            live, at = live[hit], at[hit]
            if k == 1:
                one[live] = True
            starts.append(live)
            ends.append(live + k)
            pieces.append(self.order[k][at])
        rest = np.flatnonzero(~one)
        n_bytes = 1 + (chars[rest] > 0x7F) + (chars[rest] > 0x7FF) + (chars[rest] > 0xFFFF)
        weights = np.concatenate([*(self.score[p] for p in pieces[::-1]), n_bytes * self.byte_weight])
        return np.concatenate([*starts[::-1], rest]), np.concatenate([*ends[::-1], rest + 1]), np.concatenate([*pieces[::-1], np.full(len(rest), -1)]), weights

    def encode(self, keys: list[int], texts: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each text; ``keys``: a 64-bit number per row that seeds its draws. An empty text has no ids.

        Runs of over ``stretch`` characters go by windows; the others of a text go together, ``slice_chars`` characters at a time.
        """
        parts: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, int, list[str]]] = []  # row, seed, runs
        size = 0

        def flush() -> None:
            for (row, _, _), ids in zip(waiting, self._short([s for _, s, _ in waiting], [r for _, _, r in waiting]), strict=True):
                parts[row][parts[row].index(None)] = ids
            waiting.clear()

        for row, (key, text) in enumerate(zip(keys, texts, strict=True)):
            runs, begin, at = [], 0, 0

            def close(upto: int, row: int = row, key: int = key) -> None:
                nonlocal runs, begin, size
                if runs:
                    waiting.append((row, (key + begin * int(_G)) & _MASK, runs))
                    parts[row].append(None)
                    size += upto - begin
                    if size > self.slice_chars:
                        flush()
                        size = 0
                runs, begin = [], upto

            for run in _RUN.findall(" " + text) if text else ():
                if len(run) > self.stretch:
                    close(at)
                    parts[row].append(self._long((key + at * int(_G)) & _MASK, run))
                    begin = at + len(run)
                else:
                    runs.append(run)
                at += len(run)
                if at - begin > self.slice_chars:
                    close(at)
            close(at)
        flush()
        return [b"".join(p) for p in parts]

    def _long(self, seed: int, run: str) -> bytes:
        """Ids of one run of any length: forward sums by windows, of which only the last ``widest`` are kept; then windows backwards, each summed again and drawn from."""
        chars, w = np.frombuffer(run.encode("utf-32-le"), "<u4"), self.widest
        n, carried = len(chars), [np.append(np.full(w, -np.inf), 0.0)]  # sums of the places from lo - w to lo

        def sums(lo: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            hi, left = min(lo + self.window, n), max(lo - w, 0)
            part = chars[left:hi]
            start, end, piece, weight = self.arcs(part, len(part) - np.arange(len(part)))
            start, end = start + left - (lo - w), end + left - (lo - w)
            by = np.argsort(end, kind="stable")
            by = by[np.searchsorted(end[by], w, "right") :]
            start, piece, weight = start[by], piece[by], weight[by]
            edges = np.searchsorted(end[by], np.arange(w + 1, w + hi - lo + 2))
            alpha = np.concatenate([before, np.zeros(hi - lo)])
            for i, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist(), strict=False), w + 1):
                x = alpha[start[a:b]] + weight[a:b]
                top = x.max()
                alpha[i] = top + np.log(np.exp(x - top).sum())
            return alpha, start, piece, weight, edges

        windows = range(0, n, self.window)
        for lo in windows[:-1]:
            carried.append(sums(lo, carried[-1])[0][-w - 1 :])
        at, drawn = n, []
        for lo in reversed(windows):
            alpha, start, piece, weight, edges = sums(lo, carried.pop())
            while at > lo:
                i = at - lo - 1
                a, b = edges[i], edges[i + 1]
                u = float(_scramble(np.array([(seed + (at + 1) * int(_G)) & _MASK], np.uint64))[0] >> np.uint64(11)) * 2.0**-53
                upto = np.cumsum(np.exp(alpha[start[a:b]] + weight[a:b] - alpha[at - lo + w]))
                arc = a + min(int(np.searchsorted(upto, u, "right")), b - a - 1)
                at = int(start[arc]) + lo - w
                drawn.append([int(piece[arc])] if piece[arc] >= 0 else [int(self.byte_id[x]) for x in chr(chars[at]).encode()])
        return np.asarray(list(chain.from_iterable(reversed(drawn))), "<u4").tobytes()

    def _short(self, keys: list[int], runs: list[list[str]]) -> list[bytes]:
        """Ids of rows of short runs, all at once: each different run is summed once, each occurrence drawn on its own."""
        texts = runs
        counts = np.fromiter(map(len, runs), np.int64, len(runs))
        n_runs = int(counts.sum())
        if not n_runs:
            return [b""] * len(texts)
        every = list(chain.from_iterable(runs))
        different = list(dict.fromkeys(every))
        number = dict(zip(different, range(len(different)), strict=True))
        which = np.fromiter(map(number.__getitem__, every), np.int32, n_runs)
        chars = np.frombuffer("".join(different).encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, different), np.int64, len(different))
        last = np.cumsum(size)
        first = last - size
        # Places: every run has size + 1 of them, so that ends never meet starts of the next run.
        shift = np.repeat(np.arange(len(size)), size)
        start, end, piece, weight = self.arcs(chars, last[shift] - np.arange(len(chars)))
        by = np.argsort(end, kind="stable")  # by end, longest piece first
        start, piece, weight = start[by], piece[by], weight[by]
        run = shift[start]
        a, b = (start + run).astype(np.int32), (end[by] + run).astype(np.int32)
        # Forward sums, by the length of what stands before.
        level = (b - (first + np.arange(len(size)))[run]).astype(np.int16)
        order = np.argsort(level, kind="stable")
        edges = np.searchsorted(level[order], np.arange(1, int(size.max()) + 2))
        alpha = np.full(len(chars) + len(size), -np.inf)
        alpha[first + np.arange(len(size))] = 0.0
        for lo, hi in zip(edges, edges[1:], strict=False):
            mine = order[lo:hi]
            to = b[mine]
            group = np.flatnonzero(np.diff(to, prepend=-1))
            alpha[to[group]] = np.logaddexp.reduceat(alpha[a[mine]] + weight[mine], group)
        # The arcs of an end are neighbours; ``upto`` is the running share of its sum, so a draw steps on while it lies beyond.
        upto = np.exp(alpha[a] + weight - alpha[b])
        opens = np.flatnonzero(np.diff(b, prepend=-1))
        sums = np.cumsum(upto)
        upto = sums - np.repeat(sums[opens] - upto[opens], np.diff(opens, append=len(b)))
        upto[np.append(opens[1:], len(b)) - 1] = np.inf
        entry = np.zeros(len(alpha), np.int32)
        entry[b[opens]] = opens
        # Draw backwards, all occurrences at once, each draw from the row's seed and the place in its text.
        row = np.repeat(np.arange(len(texts)), counts)
        base = np.cumsum(size[which]) - size[which]
        filled = np.flatnonzero(counts)
        begins = np.zeros(len(texts), np.int64)
        begins[filled] = base[(np.cumsum(counts) - counts)[filled]]
        home = (first + np.arange(len(size))).astype(np.int32)[which]
        at = (last + np.arange(len(size))).astype(np.int32)[which]
        seed = np.array(keys, np.uint64)[row] + (base - begins[row] - home + 1).astype(np.uint64) * _G
        live, steps = np.arange(n_runs, dtype=np.int32), []
        while len(live):
            u = (_scramble(seed + at.astype(np.uint64) * _G) >> np.uint64(11)) * 2.0**-53
            arc = entry[at]
            on = np.flatnonzero(upto[arc] <= u)
            while len(on):
                arc[on] += 1
                on = on[upto[arc[on]] <= u[on]]
            steps.append((live, arc))
            at = a[arc]
            more = at > home
            live, at, home, seed = live[more], at[more], home[more], seed[more]
        # Pieces in the order of the texts: an occurrence with n of them gets the n places after those before it, the last drawn first.
        drawn = np.zeros(n_runs, np.int32)
        for who, _ in steps:
            drawn[who] += 1
        stop = np.cumsum(drawn)
        ordered = np.empty(int(stop[-1]), np.int32)
        for k, (who, arc) in enumerate(steps, 1):
            ordered[stop[who] - k] = arc
        arc, who = ordered, np.repeat(row, drawn)
        # Ids: one a piece, or a character's bytes.
        ids = piece[arc]
        spelt = np.flatnonzero(ids < 0)
        if len(spelt):
            c = chars[start[arc[spelt]]].astype(np.int64)
            n = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            lengths = np.ones(len(ids), np.int64)
            lengths[spelt] = n
            out = np.repeat(ids, lengths)
            head = (np.cumsum(lengths) - lengths)[spelt]
            for k in range(1, 5):
                sel = n == k
                if sel.any():
                    raw = np.frombuffer("".join(map(chr, c[sel])).encode(), np.uint8).reshape(-1, k)
                    for j in range(k):
                        out[head[sel] + j] = self.byte_id[raw[:, j]]
            ids, who = out, np.repeat(who, lengths)
        per_row = np.bincount(who, minlength=len(texts))
        raw, ends = ids.astype("<u4").tobytes(), np.cumsum(per_row) * 4
        return [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), per_row.tolist(), strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces with their spaces, bytes as they are, without the space that encoding put in front."""
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:].decode()


_samplers: dict[tuple[str, float], PieceSampler] = {}


def sampler(path: str, sharpness: float) -> PieceSampler:
    """One sampler for each worker process and setting."""
    if (path, sharpness) not in _samplers:
        _samplers[path, sharpness] = PieceSampler(path, sharpness)
    return _samplers[path, sharpness]


def encode(rows: DataFrame, key: str, text: str, path: str, sharpness: float = 1.0, seed: int = 0, batch_chars: int = 300_000) -> DataFrame:
    """``key``, ``ids`` (little-endian 32-bit) and ``text``, under these names, for every row.

    The draws depend on the key's text form and ``seed`` only; equal rows segment alike. A null text gives null ids, an empty one none; a
    null key counts as an empty one. Texts are taken whole, whatever their length and however long a stretch without spaces; other
    columns are left out; an empty table gives none.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sampler(path, sharpness)
        for batch in batches:
            keys, at = [xxhash.xxh64_intdigest(str(k), seed) for k in batch.column(2).to_pylist()], 0
            while at < batch.num_rows:
                texts, chars = [], 0
                while at + len(texts) < batch.num_rows and (not texts or chars < batch_chars):
                    texts.append(batch.column(1)[at + len(texts)].as_py())
                    chars += len(texts[-1] or "")
                found = pieces.encode(keys[at : at + len(texts)], [t or "" for t in texts])
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if t is None else f for t, f in zip(texts, found, strict=True)], pa.binary()), part.column(1)], names=["key", "ids", "text"])
                at += len(texts)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k")).mapInArrow(run, f"key {kind}, ids binary, text string")


def decode(rows: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``rows`` with ``out``, the text of the column ``ids``; null for null."""

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        pieces = sampler(path, 1.0)
        return pd.Series([None if x is None else pieces.decode(x) for x in column], dtype=object)

    return rows.withColumn(out, text(F.col(ids)))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode every whole text and decode it again: doc_id, n_ids, ids_crc32, decoded_chars, decoded_crc32, lossless. Null texts give nulls and count as lossless."""
    there = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text", path)
    return decode(there, "ids", path).select(
        F.col("key").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.char_length("decoded").cast("long").alias("decoded_chars"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )
