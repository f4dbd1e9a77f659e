"""Language-model scores by stupid backoff, from n-gram counts partitioned by hash.

A text is two start marks, its words and an end mark. Each different trigram of a text goes, with how often the text has it and its
shorter n-grams, to a partition by a hash of its middle word. There all that is counted of the trigram meets: the trigram and its context
(the first two words), the bigram of the last two words and its context. A text may be scored without its own counts: they are taken
off. Places whose trigram is unknown take the bigram's share, or the word's count; the places of a text are summed per partition, then per text.

A frequent middle word is dealt by both words of the context. The counts of its bigrams are then parts, which are sent on, dealt by the
bigram, with the places that want them; so are those of words that are not among the common ones. Contexts that a partition could not
hold, and trigrams of them, are few and counted beforehand: they are dealt by all three words, or by their text.

Trigrams travel as packed arrays, one for each partition from some 200,000 words of text. Common words are numbers, others are spelt out in
each pack, so words are told apart exactly.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, discard

#: Numbers of the marks; words follow.
START, END = 0, 1
PACK = "part int, size int, block binary"
SUMS = "row long, doc_id long, n_words long, seen long, again long, score double, far long"
#: Places for which a partition is made. There are at least as many partitions as tasks, and a task takes its partitions one after the other.
PART_PLACES = 1_000_000
#: Texts whose sums a task holds.
TEXTS_HELD = 1_000_000


@dataclass
class Spelling:
    """Short codes for common words, none of which begins another: two bytes for the commonest, three for more, a length and the word itself for the rest."""

    common: dict[bytes, bytes] = field(default_factory=dict)

    @classmethod
    def of(cls, words: list[bytes]) -> Spelling:
        return cls({w: cls._short(i) for i, w in enumerate(words, 2)})

    @staticmethod
    def _short(i: int) -> bytes:
        return bytes([0x80 | i >> 8, i & 255]) if i < 1 << 14 else bytes([0xC0 | i >> 16, i >> 8 & 255, i & 255])

    def spell(self, word: bytes) -> bytes:
        if (code := self.common.get(word)) is not None:
            return code
        return bytes([len(word)]) + word if len(word) < 127 else b"\x7f" + len(word).to_bytes(4, "big") + word


def after_first(codes: Column) -> Column:
    """What follows the first word's code."""
    number = lambda at, n: F.conv(F.hex(F.substring(codes, at, n)), 16, 10).cast("int")
    head = number(1, 1)
    size = F.when(head >= 0xC0, 3).when(head >= 0x80, 2).when(head < 127, head + 1).otherwise(number(2, 4) + 5)
    return F.substring(codes, size + 1, F.octet_length(codes))


def texts_of(batches: Iterator[pa.RecordBatch], words: int = 200_000) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Texts as words between ASCII white space, A-Z lowered, some ``words`` at a time: the other columns as rows, the words of each. A longer text comes alone."""
    rows, held, n = [], [], 0
    for batch in batches:
        for *row, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1], strict=True):
            found = (text.as_py() or "").encode().lower().split()
            if held and n + len(found) > words:
                yield rows, held
                rows, held, n = [], [], 0
            rows.append(row)
            held.append(found)
            n += len(found)
    if held:
        yield rows, held


def numbered(held: list[list[bytes]]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words of some texts, and for every place its text and the numbers of the two words before it and of the word there."""
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number) + 2) for words in held for w in words]
    size = np.fromiter(map(len, held), np.int64, len(held))
    text = np.repeat(np.arange(len(held)), size + 1)
    starts = np.cumsum(size + 3) - (size + 3)
    line = np.zeros(int((size + 3).sum()), np.int64)
    at = np.arange(len(text)) + 2 * text + 2  # a place's index in the line of all texts with their marks
    line[starts + size + 2] = END
    line[at[line[at] != END]] = flat
    return list(number), text, line[at - 2], line[at - 1], line[at]


def word_counts(texts: DataFrame, flush: int = 600_000) -> DataFrame:
    """(word, n): how often each word occurs, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
        for _, held in texts_of(batches):
            for words in held:
                seen.update(words)
            if len(seen) > flush:
                yield pack()
                seen.clear()
        yield pack()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(texts: DataFrame, words: list[bytes], least: int) -> list[tuple[int, int, int, int]]:
    """(a, b, c, n) of contexts (c: -1) and trigrams that occur ``least`` times or more, all of whose words are marks or among ``words`` (numbers from 2).

    There are at most rows / ``least`` of either.
    """
    of = {w: i for i, w in enumerate(words, 2)}
    base = len(of) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in texts_of(batches):
            different, _, *abc = numbered(held)
            known = np.array([START, END, *(of.get(w, -1) for w in different)], np.int64)
            a, b, c = (known[x] for x in abc)
            pair = (a >= 0) & (b >= 0)
            for which, third in ((pair, np.full(len(c), -1)), (pair & (c >= 0), c)):
                key, n = np.unique((a[which] * base + b[which]) * (base + 1) + third[which] + 1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key // (base + 1) // base, key // (base + 1) % base, key % (base + 1) - 1, n)], names=["a", "b", "c", "n"])

    counted = texts.select("text").mapInArrow(run, "a long, b long, c long, n long").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in counted.filter(F.col("n") >= least).collect()]


def within(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every place a number of its key and word, in their order, and how often these occur together; and where each number occurs first."""
    _, key, n = np.unique(key * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True)
    first = np.empty(len(n), np.int64)
    first[key[::-1]] = np.arange(len(key))[::-1]
    return key, n[key], first


def looked_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The counts of ``wanted`` keys, 0 where there is none; ``keys`` are sorted."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


@dataclass
class Known:
    """What is known of a model beforehand: its common ``words`` by falling count (numbered from 2) with their ``counts`` by number (START: as a context), which numbers are frequent, and the (a, b, c, n) of `frequent`."""

    words: list[bytes]
    counts: np.ndarray
    is_hot: np.ndarray
    grams: list[tuple[int, int, int, int]]

    def __post_init__(self) -> None:
        self.base = len(self.words) + 2
        column = lambda table, i, none: np.array([x[i] for x in table] or [none], np.int64)
        contexts = sorted((a * self.base + b, n) for a, b, c, n in self.grams if c < 0)
        self.pairs = column(contexts, 0, -1), column(contexts, 1, 0)
        place = {key: i for i, (key, _) in enumerate(contexts)}
        thirds = sorted((place[a * self.base + b] * self.base + c, n) for a, b, c, n in self.grams if c >= 0)
        self.thirds = column(thirds, 0, -1), column(thirds, 1, 0)

    def hot(self, words: np.ndarray) -> np.ndarray:
        return self.is_hot[np.minimum(words, self.base)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Counts of frequent pairs as contexts, which are also those of the bigrams; else 0."""
        return looked_up(*self.pairs, np.where((a < self.base) & (b < self.base), a * self.base + b, -2))

    def third(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts of frequent trigrams; else 0."""
        at = np.searchsorted(self.pairs[0], a * self.base + b)
        return np.where(self.pair(a, b) > 0, looked_up(*self.thirds, np.where(c < self.base, at * self.base + c, -2)), 0)


def mixed(*numbers: np.ndarray) -> np.ndarray:
    """An even hash of some non-negative numbers."""
    h = np.zeros(len(numbers[0]), np.uint64)
    for x in numbers:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def pack(part: int, arrays: list[np.ndarray], rare: list[bytes]) -> tuple[int, int, bytes]:
    """Numbers in as few bytes as they need (8 if one is negative), byte by byte, and spelt words, compressed; with the size before that."""
    plain = [x.view(np.uint64) if x.dtype == np.int64 else x for x in arrays]
    small = [x.astype(np.min_scalar_type(x.max(initial=0))) for x in plain]
    raw = pickle.dumps(([(x.dtype.str, x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()) for x in small], rare))
    return part, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpack(size: int, block: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    arrays, rare = pickle.loads(pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True))
    whole = lambda dtype, planes: np.frombuffer(planes, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()
    return [x.astype(np.int64) if x.dtype == np.uint64 else x for x in (whole(*a) for a in arrays)], rare


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part with the places of its rows, in their order."""
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    for p, at in zip(found.tolist(), np.split(order, starts[1:]), strict=True) if len(part) else ():
        yield p, at


def local(base: int, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of word numbers whose numbers from ``base`` on are replaced by their places, from ``base`` on, in a list of those that occur; and that list."""
    rare = np.unique(np.concatenate([x[x >= base] for x in columns]))
    return [np.where(x < base, x, np.searchsorted(rare, x) + base) for x in columns], rare


class Names:
    """Numbers for the spelt words of many packs, from ``base`` on."""

    def __init__(self, base: int) -> None:
        self.base, self.number = base, {}

    def of(self, rare: list[bytes], *columns: np.ndarray) -> list[np.ndarray]:
        there = np.array([self.number.setdefault(w, self.base + len(self.number)) for w in rare] or [0], np.int64)
        columns = [x.astype(np.int64) for x in columns]
        return [np.where(x < self.base, x, there[np.maximum(x - self.base, 0)]) for x in columns] if rare else columns


def dealt(texts: DataFrame, known: Known, parts: int, counted: bool, asked: bool, apart: bool) -> DataFrame:
    """PACK of the different trigrams of some texts (row, doc_id, text), by partition.

    Per text: row + 1 (0: none, of a model's text), doc_id and whether it is null, its words, its trigrams in this pack. Per trigram: its
    words, how often the text has it, and what the text itself adds to the counts of its context, its bigram, the bigram's context and its last word (0 unless
    texts are scored ``apart``). At last whether the texts are ``counted`` in the model, ``asked`` for scores, and scored ``apart``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {w: i for i, w in enumerate(known.words, 2)}
        for rows, held in texts_of(batches):
            different, text, a, b, c = numbered(held)
            key, two_of, _ = within(text, b)
            key, two, _ = within(key, c)
            _, times, first = within(key, a)
            if apart:  # a place's context is the bigram of the place before
                at_start = np.flatnonzero(np.diff(text, prepend=-1))
                before, last = np.roll(two, 1), np.roll(two_of, -1)
                before[at_start] = 1
                last[at_start - 1] = 1  # an end mark
                own = [before, two, two_of, last]
            else:
                own = [np.zeros(len(c), np.int64)] * 4
            text, a, b, c, times, *own = (x[first] for x in (text, a, b, c, times, *own))
            number = np.array([START, END, *(of.get(w, -1) for w in different)], np.int64)
            unknown = np.flatnonzero(number < 0)
            number[unknown] = known.base + np.arange(len(unknown))
            spelt = [different[i - 2] for i in unknown]
            crc = np.array([START, END, *map(crc32, different)], np.int64)
            hash_a, hash_b, hash_c, a, b, c = crc[a], crc[b], crc[c], number[a], number[b], number[c]
            row = np.array([-1 if r[0] is None else r[0] for r in rows], np.int64) + 1
            known_of = known.pair(a, b)
            known_n = known.third(a, b, c)
            part = mixed(hash_b, np.where(known.hot(b), hash_a, 0), np.where(known_of > 0, hash_c, 0), np.where(known_n > 0, row[text] + text, 0)) % np.uint64(parts)
            doc = np.array([r[1] or 0 for r in rows], np.int64)
            nameless = np.array([r[1] is None for r in rows], np.int64)
            words = np.fromiter(map(len, held), np.int64, len(held))
            flags = np.array([counted, asked, apart], np.int64)
            packs = []
            for p, at in by_part(part.astype(np.int64)):
                here, sizes = np.unique(text[at], return_counts=True)
                grams, rare = local(known.base, a[at], b[at], c[at])
                packs.append(pack(p, [*(x[here] for x in (row, doc, nameless, words)), sizes, *grams, times[at], *(x[at] for x in own), flags], [spelt[i - known.base] for i in rare]))
            yield from packed(packs)

    return texts.select("row", "doc_id", "text").mapInArrow(run, PACK)


def packed(packs: list[tuple[int, int, bytes]], **none: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of packs, after columns that they have not."""
    part, size, block = zip(*packs, strict=True) if packs else ((), (), ())
    columns = [*(pa.nulls(len(part), t) for t in none.values()), pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(block, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=[*none, "part", "size", "block"])


SUM_TYPES = {name: pa.float64() if kind == "double" else pa.int64() for name, kind in (x.split() for x in SUMS.split(", "))}


def _flagged(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """A pack of `dealt` with how often each trigram counts, is asked for, and is the text's own; end marks are never asked for."""
    *first, c, times, of, two, two_of, one, (counted, asked, apart) = arrays
    return [*first, c, times * counted, np.where(c == END, 0, times * asked), times * apart, of, two, two_of, one]


def unpacked(table: pa.Table, names: Names, words_at: list[int], then: Callable[[list[np.ndarray]], list[np.ndarray]] = list) -> list[np.ndarray]:
    """The arrays of all packs of a group, words numbered alike."""
    out = []
    for size, block in zip(table["size"].to_pylist(), table["block"], strict=True):
        arrays, rare = unpack(size, block.as_py())
        for i, x in zip(words_at, names.of(rare, *(arrays[i] for i in words_at)), strict=True):
            arrays[i] = x
        out.append(then(arrays))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def summed(n: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every different key, and the sum of ``n`` over the rows of a row's key."""
    key = np.unique(keys, return_inverse=True)[1]
    return key, np.bincount(key, n).astype(np.int64)[key]


def in_turn(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` for the partitions of a task one after the other, with the sums of a text added up."""

    def whole(table: pa.Table) -> pa.Table:
        out, sums = [], []
        for part in sorted(set(table["part"].to_pylist())):
            made = run(table.filter(pc.equal(table["part"], part)))
            of_texts = pc.is_valid(made["row"])
            sums.append(made.filter(of_texts).select(list(SUM_TYPES)))
            if sum(map(len, sums)) > TEXTS_HELD:
                sums = [added(sums)]
                if len(sums[0]) > TEXTS_HELD // 2:
                    out.append(sums.pop())
            out.append(made.filter(pc.invert(of_texts)))
        tables = [*out, *([added(sums)] if sums else [])]
        return pa.concat_tables(tables, promote_options="default").select(made.column_names)

    return whole


def added(sums: list[pa.Table]) -> pa.Table:
    """SUMS with one row per text."""
    one = pa.concat_tables(sums).group_by("row").aggregate([("doc_id", "max"), ("n_words", "max"), *((c, "sum") for c in ("seen", "again", "score", "far"))])
    return one.rename_columns(list(SUM_TYPES))


def met(known: Known, parts: int, least: int, backoff: float, backs_off: bool) -> Callable[[pa.Table], pa.Table]:
    """Scores of a partition's places, summed per text (SUMS), and PACK of the counts and places that other partitions settle."""

    def run(table: pa.Table) -> pa.Table:
        names = Names(known.base)
        row, doc, nameless, words, sizes, a, b, c, occurs, asked, own, own_of, own_two, own_two_of, own_one = unpacked(table, names, [5, 6, 7], _flagged)
        text = np.repeat(np.arange(len(row)), sizes)
        known_n, known_of = known.third(a, b, c), known.pair(a, b)
        many = known.base + len(names.number)
        context, of = summed(occurs, b * many + a)
        n = np.where(known_n > 0, known_n, summed(occurs, context * many + c)[1])
        left, left_of = n - own, np.where(known_of > 0, known_of, of) - own_of
        seen = (asked > 0) & (left >= least)
        score, far = np.zeros(len(c)), np.zeros(len(c), np.int64)
        score[seen] = np.log(left[seen]) - np.log(left_of[seen])
        packs = []
        if backs_off:
            spread, known_two = known.hot(b), known.pair(b, c)
            pair, two = summed(occurs, b * many + c)
            two_of = np.where(spread, known.counts[np.minimum(b, known.base - 1)], summed(occurs, b)[1]) - own_two_of
            left_two = np.where(known_two > 0, known_two, two) - own_two
            unmet = (asked > 0) & ~seen
            settled = unmet & (~spread | (known_two > 0))
            near = settled & (left_two >= least)
            score[near] = np.log(left_two[near]) - np.log(two_of[near]) + math.log(backoff)
            by_word = settled & ~near & (c < known.base)
            score[by_word] = np.log(np.maximum(known.counts[c[by_word]] - own_one[by_word], 1)) + 2 * math.log(backoff)
            far[by_word] = asked[by_word]
            want = np.flatnonzero((unmet & ~settled) | (settled & ~near & ~by_word))
            want_b = np.where(settled[want], 0, b[want] + 1)
            # Parts of the counts of bigrams whose first word is spread, and of spelt words.
            pairs = np.unique(np.where(spread & (known_two == 0) & (occurs > 0), pair, -1), return_index=True)[1]
            pairs = pairs[spread[pairs] & (known_two[pairs] == 0) & (occurs[pairs] > 0)]
            rare_at = np.flatnonzero((c >= known.base) & (occurs > 0))
            rare_c, at = np.unique(c[rare_at], return_inverse=True)
            count_b, count_c = np.concatenate([b[pairs] + 1, np.zeros(len(rare_c), np.int64)]), np.concatenate([c[pairs], rare_c])
            count_n = np.concatenate([two[pairs], np.bincount(at, occurs[rare_at], minlength=len(rare_c)).astype(np.int64)])
            spelt = list(names.number)
            crc = np.fromiter(map(crc32, spelt), np.int64, len(spelt))
            target = lambda b, c: (mixed(np.where(c < known.base, c, np.append(crc, 0)[np.maximum(c - known.base, -1)]), np.where(c < known.base, b, 0)) % np.uint64(parts)).astype(np.int64)
            counts, wants = dict(by_part(target(count_b, count_c))), dict(by_part(target(want_b, c[want])))
            nothing = np.zeros(0, np.int64)
            for p in sorted(wants):
                w, k = wants[p], counts.get(p, nothing)
                here, texts = np.unique(text[want[w]], return_counts=True)
                (of_want, of_count), rare = local(known.base, c[want[w]], count_c[k])
                packs.append(pack(p, [row[here], texts, want_b[w], of_want, *(x[want[w]] for x in (asked, own_two, two_of, own_one)), count_b[k], of_count, count_n[k]], [spelt[i - known.base] for i in rare]))
            for p in sorted(counts.keys() - wants.keys()):
                (of_count,), rare = local(known.base, count_c[counts[p]])
                packs.append(pack(p, [*[nothing] * 8, count_b[counts[p]], of_count, count_n[counts[p]]], [spelt[i - known.base] for i in rare]))
        total = lambda x: np.bincount(text, x, minlength=len(row))
        ends = np.zeros(len(row), bool)
        ends[text[c == END]] = True
        sums = [total(np.where(seen, asked, 0)), total(np.where(n > 1, asked, 0)), total(score * asked), total(far)]
        keep = (row > 0) & (ends | (total(asked) > 0))
        columns = [row - 1, pa.array(doc[keep], mask=((nameless > 0) | ~ends)[keep]), pa.array(words[keep], mask=~ends[keep]), *sums]
        columns = [(x if isinstance(x, pa.Array) else pa.array(x[keep])).cast(t) for x, t in zip(columns, SUM_TYPES.values(), strict=True)]
        lacks = [pa.nulls(int(keep.sum()), t) for t in (pa.int32(), pa.int32(), pa.binary())]
        done = pa.RecordBatch.from_arrays([*columns, *lacks], names=[*SUM_TYPES, "part", "size", "block"])
        return pa.Table.from_batches([done, *packed(packs, **SUM_TYPES)])

    return run


def settled_elsewhere(known: Known, least: int, backoff: float) -> Callable[[pa.Table], pa.Table]:
    """Scores of the places that `met` sent on: the bigram's share of its context, else the word's count."""

    def run(table: pa.Table) -> pa.Table:
        names = Names(known.base)
        row, sizes, b, c, asked, own_two, two_of, own_one, count_b, count_c, count_n = unpacked(table, names, [3, 9])
        text = np.repeat(np.arange(len(row)), sizes)

        def count(first: np.ndarray) -> np.ndarray:
            key = np.unique(np.concatenate([count_c, c]) * (known.base + 1) + np.concatenate([count_b, first]), return_inverse=True)[1]
            return np.bincount(key[: len(count_c)], count_n, minlength=int(key.max(initial=0)) + 1).astype(np.int64)[key[len(count_c) :]]

        two = count(b) - own_two
        near = (b > 0) & (two >= least)
        score = np.zeros(len(c))
        score[near] = np.log(two[near]) - np.log(two_of[near]) + math.log(backoff)
        one = np.where(c < known.base, known.counts[np.minimum(c, known.base - 1)], count(np.zeros(len(c), np.int64))) - own_one
        score[~near] = np.log(np.maximum(one[~near], 1)) + 2 * math.log(backoff)
        total = lambda x: np.bincount(text, x, minlength=len(row))
        columns = [row - 1, None, None, np.zeros(len(row)), np.zeros(len(row)), total(score * asked), total(np.where(near, 0, asked))]
        return pa.table([pa.nulls(len(row), t) if x is None else pa.array(x).cast(t) for x, t in zip(columns, SUM_TYPES.values(), strict=True)], names=list(SUM_TYPES))

    return run


def common_from(words: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` words."""
    falling = [(r["n"], r["k"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()]
    found, so_far = falling[0][0] + 1 if falling else 1, 0
    for n, k in falling:
        if (so_far := so_far + k) > most:
            break
        found = n
    return found


def backoff_scores(docs: DataFrame, model: DataFrame | None = None, least: int = 1, backoff: float = 0.4, spelt: int = 1 << 18, share: int = 4, rare: int = 1000, apart: bool = False) -> DataFrame:
    """Trigram score of every whole text of ``docs`` (doc_id, text) under the counts of ``model`` (text; by default ``docs`` itself).

    A word after two others scores the trigram's count over that of its context if the trigram occurs ``least`` times or more, else
    ``backoff`` times the bigram's share of its context, else ``backoff`` squared times the word's share of all places; a word the model
    lacks counts as one. ``apart``: each row's text is scored by the other rows alone, that is all counts without its own (no ``model``
    then). Words are what stands between ASCII white space, A-Z lowered; start and end marks are context and counted, but end marks
    aren't scored.

    Returns doc_id, n_words, log_score, mean_score (per word; null without words), n_seen (places whose trigram the model has), n_again
    (those whose trigram occurs at another place too, of the same text or not). Null and empty texts have no words and score 0; repeated
    rows each count and each get their row, and are other texts to each other; very long texts are read whole; other columns are ignored;
    an empty table gives none. Rows are told apart by their place in the table's files, which a task that is run again after a lost
    executor reads in the same order; give a written table, not one whose row order may change.

    ``spelt`` words at the most, and all frequent ones, get numbers, the others are spelt out: it changes no result. A word or context with over 1 / (``share`` x partitions) of
    all places, and ``rare`` at least, counts as frequent; there are at most ``share`` x partitions, or more where that would be over 2 x PART_PLACES.
    """
    if apart and model is not None:
        raise ValueError("texts have no counts of their own in another model")
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = texts if model is None else model.select("text")
    words = cut(word_counts(known), "words")
    n_docs = known.count()
    total = (words.agg(F.sum("n")).first()[0] or 0) + n_docs
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tasks * max(1, -(-total // (tasks * PART_PLACES)))
    limit = max(rare, least, min(total // (share * tasks), 2 * PART_PLACES))
    table = words.filter(F.col("n") >= min(limit, common_from(words, spelt))).toArrow()
    discard(words)
    counts = table["n"].to_numpy()
    order = np.argsort(-counts, kind="stable")
    common, counts = table["word"].combine_chunks().take(pa.array(order)).to_pylist() if len(order) else [], np.array([n_docs, 0, *counts[order]], np.int64)
    hot = frequent(known, common[: int((counts[2:] >= limit).sum())], limit) if total >= limit else []
    model_known = Known(common, counts, np.append(counts >= limit, False), hot)
    packs = dealt(texts, model_known, parts, model is None, True, apart)
    if model is not None:
        nameless = known.select(F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), "text")
        packs = packs.unionByName(dealt(nameless, model_known, parts, True, False, False))
    backs_off = model is not None or least > 1 or apart
    together = lambda packs: packs.withColumn("task", F.col("part") % tasks).repartition(tasks, "task").groupBy("task")
    first = together(packs).applyInArrow(in_turn(met(model_known, parts, least, backoff, backs_off)), f"{SUMS}, {PACK}")
    if backs_off:
        first = cut(first, "places")
    rows = first.filter("row IS NOT NULL").select(*SUM_TYPES)
    if backs_off:
        on = first.filter("part IS NOT NULL").select("part", "size", "block")
        rows = rows.unionByName(together(on).applyInArrow(in_turn(settled_elsewhere(model_known, least, backoff)), SUMS))
    sums = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "seen", "again", "score", "far")))
    rest = F.lit(total) - F.when(F.lit(apart), F.col("n_words") + 1).otherwise(0)
    score = F.col("score") - F.col("far") * F.log(F.greatest(rest, F.lit(1)))
    whole = sums.select("doc_id", "n_words", score.alias("log_score"), F.col("seen").alias("n_seen"), F.col("again").alias("n_again"))
    return whole.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_score"), "n_seen", "n_again")
