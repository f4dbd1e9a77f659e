"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, report, other) by a lexicon whose insult entries are learned from labels. A
transducer that reads a clause from its end marks the insults and threats that a target follows; small ones that read it from its start,
one for each idea, are composed into one table of states; a clause's weight is that of its path. So "you are an <insult>" weighs more
than the insult alone, "not an <insult>" and "she said ... <insult>" far less, and "<threat> you" weighs as much as "you <threat>".
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, sampled

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INSULT_AT, THREAT_AT = range(8)
#: Insults and threats become these where a target follows.
AT = {INSULT: INSULT_AT, THREAT: THREAT_AT}
KINDS = range(8)
#: Words within which a target belongs to an insult or threat, on either side.
REACH = 4
#: Function words of the grammar in English, German, French and Spanish (fixed values).
WORDS = {
    THREAT: "kill hurt destroy stab shoot strangle umbringen töten verletzen tuer blesser détruire matar herir destruir",
    TARGET: "you your yours u ya du dich dir ihr euch tu toi vous te tú usted ustedes vosotros he she him her they them",
    NEGATION: "not never no isn aren wasn weren don doesn didn nicht nie kein keine keinen ne pas jamais nunca tampoco",
    REPORT: "said says wrote writes quoted quotes reported alleged called according sagte schrieb laut zitierte dit disait écrit selon dijo dice escribió según",
}
_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = range(4, 9)
#: Score from which a text counts as toxic.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer over word classes: ``step(state, symbol) -> (state, factor)``; state 0 starts a clause."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    states: int

    def compose(self, other: Transducer) -> Transducer:
        """Both run side by side: states are reachable pairs, factors multiply."""
        index, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in KINDS:
                a, f = self.arcs[pair[0], symbol]
                b, g = other.arcs[pair[1], symbol]
                if (a, b) not in index:
                    index[a, b] = len(index)
                    todo.append((a, b))
                arcs[index[pair], symbol] = (index[a, b], f * g)
        return Transducer(arcs, len(index))


def near(trigger: int, subject: int, reach: int, factor: float, without: float = 1.0) -> Transducer:
    """``subject`` within ``reach`` words after ``trigger`` gets ``factor``, elsewhere ``without``; a target may also follow it."""
    arcs = {}
    for state in range(reach + 1):
        for symbol in KINDS:
            after = reach if symbol == trigger else max(state - 1, 0)
            met = state or trigger == TARGET and symbol == AT[subject]
            arcs[state, symbol] = (after, (factor if met else without) if symbol in (subject, AT[subject]) else 1.0)
    return Transducer(arcs, reach + 1)


def since(trigger: int, subjects: tuple[int, ...], factor: float) -> Transducer:
    """``subjects`` anywhere after ``trigger`` in the clause get ``factor``."""
    hit = {*subjects, *(AT[x] for x in subjects)}
    return Transducer({(s, x): (1 if s or x == trigger else 0, factor if s and x in hit else 1.0) for s in (0, 1) for x in KINDS}, 2)


def facing(kinds: list[int], reach: int = REACH) -> list[int]:
    """Word classes of a clause, read from its end: an insult or threat with a target within ``reach`` words after it becomes its class in ``AT``."""
    out, state = kinds[:], 0
    for i in range(len(kinds) - 1, -1, -1):
        if state:
            out[i] = AT.get(kinds[i], kinds[i])
        state = reach if kinds[i] == TARGET else max(state - 1, 0)
    return out


def grammar() -> Transducer:
    """Target beside insult or threat, negation before either, reported speech: one machine. A threat without a target weighs nothing."""
    parts = [near(TARGET, INSULT, REACH, 1.3), near(TARGET, THREAT, REACH, 1.0, 0.0), near(NEGATION, INSULT, 3, 0.25), near(NEGATION, THREAT, 3, 0.1), since(REPORT, (INSULT, THREAT), 0.4)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.compose(part)
    return whole


@dataclass
class Lexicon:
    """Insult entries with weights: whole words, and stems that match at the start of a longer word; ``bias`` is the score without a match."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    slope: float = 1.0
    threat: float = 6.0


class Scorer:
    """Scores texts with a lexicon and the grammar. A text without any entry or threat word is settled by one pass of a matcher."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.lexicon, self.machine = lexicon, grammar()
        self.fixed = {w: c for c, ws in WORDS.items() for w in ws.split()}
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for w in {*lexicon.words, *lexicon.stems, *WORDS[THREAT].split()}:
            self.matcher.add_word(w, 1)
        self.matcher.make_automaton()

    def entry(self, word: str) -> tuple[int, float]:
        if word in self.lexicon.words:
            return INSULT, self.lexicon.words[word]
        for k in PREFIXES:
            if len(word) > k and word[:k] in self.lexicon.stems:
                return INSULT, self.lexicon.stems[word[:k]]
        kind = self.fixed.get(word, OTHER)
        return kind, self.lexicon.threat if kind == THREAT else 0.0

    def clause(self, clause: str) -> float:
        state, total = 0, 0.0
        found = [self.entry(word) for word in _WORD.findall(clause)]
        for kind, (_, weight) in zip(facing([kind for kind, _ in found]), found, strict=True):
            state, factor = self.machine.arcs[state, kind]
            total += weight * factor
        return total

    def score(self, text: str | None) -> tuple[float, float, int]:
        """Probability, total weight, and the number of clauses that weigh anything."""
        low = (text or "").lower()
        total, matched = 0.0, 0
        if next(self.matcher.iter(low), None) is not None:
            for clause in _CLAUSE.split(low):
                if next(self.matcher.iter(clause), None) is not None and (weight := self.clause(clause)):
                    total += weight
                    matched += 1
        odds = self.lexicon.bias + self.lexicon.slope * total
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), total, matched


def features(text: str) -> dict[str, float]:
    """Words of a text (``=word``) and the starts of longer ones (``start*``), each with the root of how often it occurs: a text that says one word without end says little."""
    seen: Counter[str] = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        if len(w) > 2:
            seen[f"={w}"] += n
        for k in PREFIXES:
            if len(w) > k:
                seen[f"{w[:k]}*"] += n
    return {f: math.sqrt(n) for f, n in seen.items()}


def origin(text: str) -> int:
    """One value for most near copies: the least hash of a text's five-word runs."""
    import xxhash

    words = text.encode().lower().split()
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def learn(labelled: DataFrame, sample: int = 20_000, support: int = 4) -> Lexicon:
    """Insult entries from ``labelled`` (text, toxic; ``row``, a repeatable row number, if it has one).

    The fit reads the whole texts of at most about ``sample`` rows, by a hash of text and row number: rows of one doc_id, or without one,
    are as many as they are. An entry must occur in
    toxic texts of ``support`` different origins (near copies count once) and far more often than in others; of the many words that stand beside
    insults, only those stay that explain texts which better entries don't. Candidates and entries are as many as the sample holds; that
    bounds what the driver gets. Null texts and labels teach nothing.
    """
    number = F.col("row") if "row" in labelled.columns else F.monotonically_increasing_id()
    rows = labelled.filter(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic"), number.alias("row"))
    rows = cut(sampled(rows, sample).select("text", "toxic"), "labelled")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = features(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([origin(text.as_py())] * len(found), pa.int64()), pa.array(list(found.values()), pa.float64())], names=["feature", "origin", "n"])

    toxic = rows.filter("toxic = 1").select("text").mapInArrow(toxic_features, "feature string, origin long, n double")
    wide = toxic.groupBy("feature").agg(F.countDistinct("origin").alias("origins"), F.sum("n").alias("n")).filter(F.col("origins") >= support)
    common = {r["feature"]: r["n"] for r in wide.collect()}

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = defaultdict(float)
        for batch in batches:
            for text in batch.column(0):
                for f, n in features(text.as_py()).items():
                    if f in common:
                        seen[f] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.float64())], names=["feature", "n"])

    clean = {r[0]: r[1] for r in rows.filter("toxic <> 1").select("text").mapInArrow(clean_counts, "feature string, n double").groupBy("feature").agg(F.sum("n")).collect()}
    weight = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in common.items()}
    good = {f for f, w in weight.items() if w >= 2.5}

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = sorted(features(text.as_py()).keys() & good)
                yield pa.RecordBatch.from_arrays([pa.array([origin(text.as_py())], pa.int64()), pa.array([found], pa.list_(pa.string()))], names=["origin", "found"])

    have = rows.filter("toxic = 1").select("text").mapInArrow(cases, "origin long, found array<string>").groupBy("origin").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    lexicon = Lexicon()
    if not n_toxic:
        return lexicon
    for f in cover([set(r["found"]) for r in have.collect()], weight, support):
        (lexicon.words if f[0] == "=" else lexicon.stems)[f.strip("=*")] = min(7.5, weight[f])
    totals = with_toxicity(rows, replace(lexicon, bias=0.0), "_t")
    bins = totals.groupBy(F.least(F.round("_t.total", 0), F.lit(40.0)).alias("x"), (F.col("toxic") == 1).alias("y")).count().collect()
    return replace(lexicon, **calibrate([(r["x"], r["y"], r["count"]) for r in bins]))


def calibrate(bins: list[tuple[float, bool, int]], rounds: int = 50) -> dict[str, float]:
    """Bias and slope of a logistic curve through counts of labels by total weight, both kept within sane limits."""
    x, y, n = (np.asarray([b[i] for b in bins], float) for i in range(3))
    bias, slope = -4.0, 0.7
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(bias + slope * x)))
        error, spread = n * (y - p), n * p * (1 - p)
        g = np.array([error.sum() - (bias + 4), (error * x).sum() - 10 * (slope - 0.7)])
        h = np.array([[spread.sum() + 1, (spread * x).sum()], [(spread * x).sum(), (spread * x * x).sum() + 10]])
        step = np.linalg.solve(h, g)
        bias, slope = float(np.clip(bias + step[0], -8, -2)), float(np.clip(slope + step[1], 0.3, 2.0))
    return {"bias": bias, "slope": slope}


def cover(texts: list[set[str]], weight: dict[str, float], support: int, times: int = 6) -> list[str]:
    """Features, best first, until every text has ``times`` of them or no feature is left that ``support`` unfinished texts have.

    Of equally good ones the longest is taken, then those of the same texts that it implies are passed over.
    """
    at: dict[str, set[int]] = defaultdict(set)
    for i, found in enumerate(texts):
        for f in found:
            at[f].add(i)
    need, out = [times] * len(texts), []
    while at:
        best = max(at, key=lambda f: (len(at[f]) * weight[f], len(f), f))
        if len(at[best]) < support:
            break
        out.append(best)
        mine = at.pop(best)
        core = best.strip("=*")
        for f in [f for f in at if core.startswith(f.strip("=*")) or best[-1] == "*" and f.strip("=*").startswith(core)]:
            del at[f]
        done = set()
        for i in mine:
            need[i] -= 1
            if need[i] <= 0:
                done.add(i)
        if done:
            for f in list(at):
                at[f] -= done
                if not at[f]:
                    del at[f]
    return out


def with_toxicity(docs: DataFrame, lexicon: Lexicon, out: str) -> DataFrame:
    """``docs`` with a struct column ``out`` (score, total weight, clauses that weigh anything) from the whole text alone.

    A null or empty text has the score of no match. Very long texts are read whole, clause by clause; rows don't meet, so repeated ones score alike.
    """
    made: list[Scorer] = []  # one for a task

    @F.arrow_udf("score double, total double, clauses int")
    def rate(text: pa.Array) -> pa.Array:
        if not made:
            made.append(Scorer(lexicon))
        found = [made[0].score(t.as_py()) for t in text]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.int32()))], names=["score", "total", "clauses"])

    return docs.withColumn(out, rate("text"))


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` up), total, clauses of every row."""
    out = with_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lexicon, "_t")
    return out.select("doc_id", "_t.score", (F.col("_t.score") >= threshold).cast("int").alias("predicted"), "_t.total", "_t.clauses")


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels aren't learned: CRC-32 of doc_id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from the labelled rows that aren't held out. Labels that disagree about a document count as toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")).join(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all of ``docs``. Columns: doc_id, held_out, score, predicted, total, clauses.

    Every row gets a score, null and empty texts and repeated rows too; other columns of ``docs``, whatever their names, are left out;
    without labels only the fixed words of the grammar weigh; an empty table gives none.
    """
    return score(docs, fit(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "total", "clauses")
