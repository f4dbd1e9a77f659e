"""Training-data operators against plain versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, language, lm, packing, pieces, quality, sharding, simhash, topk, toxicity
from tidemark.llm.common import attach, gapless
from tidemark.llm.queries import oracle_sql, queries, tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, _k int"
LONG = "word " * 30_000
ODD = [None, "", " \n\t", "a", "a", "ä\x1c  b", "▁x ▁", "<|endoftext|> <|im_end|>\\<|", "1234 ++ !!", "no letters? 中文", LONG, "x" * 5000]


def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, None, None, None, "s", i) for i, t in enumerate(ODD)] + [(3, "a", "en", "s", 1, None, 1), (3, "a", "en", "s", 1, None, 1), (None, "a b c d", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# Chat formatting


def test_chat_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("conversations", "embeddings", "documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        want = con.sql(sql)
        columns = sorted(want.columns)
        got = sorted((tuple(r[c] for c in columns) for r in queries()[name](spark, sf_dir).collect()), key=str)
        order = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str), name


def test_chat_round_trip_of_awkward_turns(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "\\", "<|", "\\<|im_sep|>", "<\\|", "a<", "|b", None, "", "x\n<|im_end|>\n", "<|im_turn|>"]
    rows = [(1, i, "assistant" if i % 3 else "us<|er\n", t, 1) for i, t in enumerate(said)] + [(2, None, None, "t", 0), (2, None, None, "t", 0), (None, 1, "user", "u", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, mask int")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(said)]]
    assert [t["text"] for t in out[2]["turns"]] == ["t", "t"] and len(out) == 3
    d = {r["conv_id"]: r for r in chat.digest(chat.format_turns(turns)).collect()}
    loss = "".join(r[3] or "" for r in rows[: len(said)] if r[2] == "assistant")
    assert d[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and d[1]["loss_chars"] == len(loss) and d[1]["n_turns"] == len(said)
    assert d[1]["n_blocks"] == 8
    assert chat.digest(chat.format_turns(turns.limit(0))).count() == 0


# Sharding


def laws(rows, shards=8):
    per = Counter(r["shard"] for r in rows)
    assert len(rows) < shards or max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for s in per:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(per[s]))


def test_sharding_keeps_groups_and_balance(spark, docs, texts):
    rows = sharding.digest(docs).collect()
    laws(rows)
    assert Counter(r["doc_id"] for r in rows) == Counter(list(texts))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 for r in rows)
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_sharding_splits_a_hot_group_and_swaps_full_shards(spark):
    hot = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 150, "hot").otherwise(F.floor(F.col("id") / 2).cast("string")).alias("text"))
    rows = sharding.digest(hot).collect()
    laws(rows)
    spread = Counter(r["shard"] for r in rows if r["doc_id"] < 150)
    assert max(spread.values()) >= 30  # dealt around the shards it began with 19
    pairs = {}
    for r in rows:
        if r["doc_id"] >= 150:
            pairs.setdefault(r["doc_id"] // 2, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in pairs.values()) <= 12  # nothing is free here: moves are swaps


def test_sharding_cuts_as_little_as_the_best_placing(spark):
    """All placings of a few groups on two shards of equal size, tried one by one: where one cuts nothing, nothing is cut."""
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(6):
        sizes = [rng.randint(1, 5) for _ in range(7)]
        n = sum(sizes)
        sizes += [1] * 6  # documents without a link fill the rest
        n += 6
        texts = [f"t{g}" for g, size in enumerate(sizes) for _ in range(size)]
        placed = sharding.shard_rows(sharding.items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), shards=2)
        cut = sharding.cut_edges(placed).first()["cut"]
        halves = {sum(s for s, side in zip(sizes, sides, strict=True) if side) for sides in itertools.product((0, 1), repeat=len(sizes))}
        assert n // 2 in halves and cut == 0
        assert placed.filter("whole").count() == n


def test_sharding_ends_only_when_no_move_is_admitted(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 20).cast("string").alias("text"))
    rows = sharding.shard_rows(sharding.items(docs)).collect()
    laws(rows)
    split = {r["key"] for r in rows if not r["whole"]}
    places = {}
    for r in rows:
        places.setdefault(r["key"], set()).add(r["shard"])
    assert {k for k, s in places.items() if len(s) > 1} == split


def test_sharding_of_awkward_rows(spark):
    laws(sharding.digest(odd_docs(spark)).collect())
    assert sharding.digest(empty_docs(spark)).count() == 0


# Packing


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(tokenizer_path())
    for t in [x or "" for x in ODD] + ["'s don't  \n\n\t x\r\n 　y"]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_patterns_are_laid_with_any_length_of_their_classes():
    """Only the eighth length of the class has a partner."""
    plan = packing.plan_packing({2048 - i: 1 for i in range(1, 8)} | {2048 - 9: 5, 9: 5})
    assert plan.sequences == 12


def test_plans_place_every_piece_once():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        histogram = Counter(rng.integers(1, rng.choice([10, 100, 1024, 2049]), rng.integers(1, 400)).tolist())
        plan = packing.plan_packing(dict(histogram))
        placed, bins = sorted(plan.placed), {}
        for i, (length, rank, first, each, base) in enumerate(placed):
            end = placed[i + 1][1] if i + 1 < len(placed) and placed[i + 1][0] == length else histogram[length]
            for j in range(end - rank):
                bins.setdefault(first + j // each, []).append((base + j % each * length, length))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(k * v for k, v in histogram.items())
        assert sum(map(len, bins.values())) == sum(histogram.values()) and len(bins) == plan.sequences
        assert plan.sequences <= max(-(-total // 2048) * 1.25 + 1, sum(v for k, v in histogram.items() if k > 1024) + 1)


def test_packing_matches_a_plain_version(spark, docs, texts):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.packed_digest(docs, tokenizer_path()).collect()
    want = {}
    for d, text in texts.items():
        ids = np.asarray([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want |= {(d, i): (a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for h in held.values():
        at = 0
        for offset, length in sorted(h):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(n for _, n, _ in want.values())
    assert len(held) <= 1.05 * -(-total // 2048) + 1


def test_packed_sequences_and_awkward_rows(spark):
    p = packing.token_pieces(odd_docs(spark), tokenizer_path())
    from tidemark.llm.common import cut

    packed = packing.pack(cut(p, "t"))
    assert packed.count() == p.count() and packed.agg(F.sum("length")).first()[0] == packing.sequences(packed).agg(F.sum(F.octet_length("ids") / 4)).first()[0]
    assert packing.packed_digest(empty_docs(spark), tokenizer_path()).count() == 0


# Language


def test_language_on_held_out_rows(spark, docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_rows(spark, docs):
    model = language.train(docs)
    out = language.predict(odd_docs(spark), model).collect()
    assert len(out) == len(ODD) + 3
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by[0] == by[1] == by[2] == by[8] == "und" and by[10] != "und"
    assert language.identify(empty_docs(spark)).count() == 0
    assert language.train(empty_docs(spark)).languages == ("und",)


def test_language_matches_a_plain_decoder(docs, texts):
    """Counts of every n-gram in memory, then the losses of each code word, one text at a time."""
    model = language.train(docs)
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    counts = {x: Counter() for x in model.languages}
    for d, t in texts.items():
        if lang[d]:
            counts[lang[d]].update(language.ngram_slots(t.encode()).tolist())
    shares = []
    for x in model.languages:
        c = np.zeros(language.SLOTS)
        c[list(counts[x])] = list(counts[x].values())
        bands = np.split(c, [language.PAIRS, language.PAIRS + language.HASHED])
        shares.append(np.concatenate([(b + 0.5) / (b.sum() + 0.5 * np.count_nonzero(b) + 1) for b in bands]))
    shares = np.asarray(shares)
    for d, t in list(texts.items())[:60]:
        slots, costs = language.ngram_slots(t.encode()), []
        margin = [np.clip(np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0)), -6, 6)[slots].mean() for bit in model.code.T]
        for word in model.code:
            costs.append(sum(math.log1p(math.exp(-8.0 * b * m)) for b, m in zip(word, margin, strict=True)))
        got, score = model.decode(t.encode())
        rest = [math.exp(min(costs) - c) for c in costs]
        assert model.languages[int(np.argmin(costs))] == got and score == pytest.approx(max(rest) / sum(rest), abs=1e-4)


def test_language_training_over_many_tasks(spark, docs):
    few, many = (language.train(docs.repartition(n)) for n in (2, 150))
    assert few.languages == many.languages and (few.weights == many.weights).all()


def test_code_words_are_apart():
    for k in (2, 4, 7, 12, 40):
        code = language.code_words(k)
        gaps = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert min(gaps) >= (1 if k == 2 else code.shape[1] // 4)


# Near duplicates


def plain_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """doc_id to least reachable doc_id, all pairs compared."""
    ids, fps = [i for i, _ in prints], np.array([f for _, f in prints], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


def test_simhash_matches_all_pairs(docs, texts):
    rows = {r["doc_id"]: r for r in simhash.digest(docs).collect()}
    prints = [(d, plain_fingerprint(t)) for d, t in texts.items()]
    assert {d: f"{f:016x}" for d, f in prints} == {d: r["fingerprint"] for d, r in rows.items()}
    assert plain_components(prints) == {d: r["component_id"] for d, r in rows.items()}


def test_anchors_cover_every_pair_within_two_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    fps = {int(x) for x in base} | {0, 2**64 - 1}
    for x in list(fps):
        for _ in range(12):
            i, j = rng.integers(0, 64, 2).tolist()
            fps.add(x ^ (1 << i) ^ ((1 << j) if i != j else 0))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    sent = simhash.to_anchors(df).collect()
    at = {}
    for r in sent:
        at.setdefault(r["fp"], set()).add(r["anchor"])
    assert max(map(len, at.values())) <= 33
    for i, x in enumerate(signed):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                assert at[x] & at[signed[j]]
    linked = simhash.components(simhash.links(df))
    want = plain_components(list(zip(signed, [f & (2**64 - 1) for f in signed], strict=True)))
    roots = {r["node"]: r["root"] for r in linked.collect()}
    assert {x: roots.get(x, x) for x in signed} == want


def test_simhash_of_awkward_rows(spark):
    rows = simhash.near_duplicates(odd_docs(spark)).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == len(ODD) + 3 and by[0] == by[1] == by[2] == 0 and by[4] == by[3] == 3 and by[None] is None
    kept = simhash.one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {0, 3, None} <= set(ids) and not {1, 2, 4} & set(ids)
    assert simhash.digest(empty_docs(spark)).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{x}{i * i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, b.upper()), (5, c), (5, a + " "), (3, a), (7, None), (None, ""), (None, None)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0, (r["text"] or "").lower()[:2]) for r in kept)) == [(0, "b0"), (3, "a0"), (5, "c0"), (7, "")]


def test_no_pair_of_similar_shingle_sets_stays(spark):
    import random

    rng = random.Random(1)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 40, 150, 400]))]
        for _ in range(8):
            mine = [f"x{rng.randrange(10**6)}" if rng.random() < 0.03 else w for w in words]
            rows += [(len(rows), " ".join(mine))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    near = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    label = {i: i for i in sets}
    for _ in sets:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    prints = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    assert near and kept == {i for i in sets if label[i] == i and prints[i] == i}


def test_outlines_never_rule_out_a_similar_pair():
    from tidemark.llm import overlap

    rng = np.random.default_rng(2)
    ruled_out = 0
    for n in (1, 5, 60, 300, 513, 3000, 9000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, max(1, n // 12), dtype=np.uint64)]))
            c = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            assert overlap.most_shared(overlap.outline(a), overlap.outline(b)) >= len(np.intersect1d(a, b))
            ruled_out += overlap.most_shared(overlap.outline(a), overlap.outline(c)) < 8 / 9 * n
    assert ruled_out > 100
    same = np.arange(1000, dtype=np.uint64)  # all in one range: counts are cut off
    assert overlap.most_shared(overlap.outline(same), overlap.outline(same)) == math.inf


def test_long_chains_settle(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert simhash.components(edges).agg(F.max("root")).first()[0] == 0


# Language-model scores


def plain_backoff(texts, model, least):
    """(n_words, log_score, n_seen, n_again) of each text, from counts in memory."""
    split = lambda t: (t or "").encode().lower().split()
    three, two, one = Counter(), Counter(), Counter()
    for w in map(split, model):
        line = [0, 0, *w, 1]
        three.update(zip(line, line[1:], line[2:], strict=False))
        two.update(zip(line[1:], line[2:], strict=False))
        one.update(line[2:])
    after_two, after_one, total, out = Counter(), Counter(), sum(one.values()), []
    for (a, b, _), n in three.items():
        after_two[a, b] += n
    for (a, _), n in two.items():
        after_one[a] += n
    for w in map(split, texts):
        line, score, seen, again = [0, 0, *w], 0.0, 0, 0
        for a, b, c in zip(line, line[1:], line[2:], strict=False):
            n = three[a, b, c]
            seen, again = seen + (n >= least), again + (n > 1)
            share = n / after_two[a, b] if n >= least else 0.4 * two[b, c] / after_one[b] if two[b, c] >= least else 0.16 * max(one[c], 1) / total
            score += math.log(share)
        out.append((len(w), score, seen, again))
    return out


def same_scores(rows, texts, want):
    rows = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for d, (n, score, seen, again) in zip(texts, want, strict=True):
        r = rows[d]
        assert (r["n_words"], r["n_seen"], r["n_again"]) == (n, seen, again) and r["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_backoff_matches_a_plain_version(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = lm.backoff_scores(docs).collect()
    same_scores(rows, texts, plain_backoff(texts.values(), texts.values(), 1))
    assert all(math.isfinite(r["log_score"]) and r["log_score"] <= 0 for r in rows)


def test_backoff_with_frequent_contexts_pruning_and_another_model(spark, docs, texts):
    said = list(texts.values())
    same_scores(lm.backoff_scores(docs, rare=20).collect(), texts, plain_backoff(said, said, 1))
    same_scores(lm.backoff_scores(docs, least=2, rare=20).collect(), texts, plain_backoff(said, said, 2))
    model = docs.filter("doc_id % 3 = 0")
    same_scores(lm.backoff_scores(docs, model, rare=20, spelt=50).collect(), texts, plain_backoff(said, [t for d, t in texts.items() if d % 3 == 0], 1))


def plain_backoff_apart(texts):
    """The same, each text under the counts of the others: all counts less its own."""
    lines = [[0, 0, *(t or "").encode().lower().split(), 1] for t in texts]
    grams = lambda line: (Counter(zip(line, line[1:], line[2:], strict=False)), Counter(zip(line[1:], line[2:], strict=False)), Counter(line[2:]))
    three, two, one, of_three, of_two = Counter(), Counter(), Counter(), Counter(), Counter()
    for line in lines:
        for total, part in zip((three, two, one), grams(line), strict=True):
            total.update(part)
    for (a, b, _), n in three.items():
        of_three[a, b] += n
    for (a, _), n in two.items():
        of_two[a] += n
    everything, out = one.total(), []
    for line in lines:
        mine3, mine2, mine1 = grams(line)
        score, seen, again = 0.0, 0, 0
        mine_of3, mine_of2 = Counter(zip(line, line[1:-1], strict=False)), Counter(line[1:-1])
        for a, b, c in zip(line, line[1:], line[2:-1], strict=False):
            n, m = three[a, b, c] - mine3[a, b, c], two[b, c] - mine2[b, c]
            seen, again = seen + (n > 0), again + (three[a, b, c] > 1)
            if n:
                share = n / (of_three[a, b] - mine_of3[a, b])
            elif m:
                share = 0.4 * m / (of_two[b] - mine_of2[b])
            else:
                share = 0.16 * max(one[c] - mine1[c], 1) / max(everything - len(line) + 2, 1)
            score += math.log(share)
        out.append((len(line) - 3, score, seen, again))
    return out


@pytest.mark.parametrize(("sf", "rare"), [("sf0.001", 1000), ("sf0.001", 20), ("sf0.1", 1000)])
def test_scores_apart_from_own_counts_match_a_plain_version(spark, sf, rare):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = lm.backoff_scores(docs, rare=rare, apart=True).collect()
    same_scores(rows, texts, plain_backoff_apart(texts.values()))
    assert all(math.isfinite(r["log_score"]) and r["log_score"] <= 0 for r in rows)
    # Backoff is at work: most texts have places that no other text knows.
    assert sum(r["n_seen"] < r["n_words"] for r in rows) > len(rows) / 2


def test_scores_apart_of_repeats_one_text_and_awkward_rows(spark):
    many = [(1, "a b c"), (1, "a b c"), (2, "a a a a a a"), (3, None), (4, ""), (5, "A\tB\nd"), (6, "b")] + [(k, f"the same start {k} " * 30) for k in range(10, 60)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    for rare in (3, 1000):
        rows = lm.backoff_scores(docs, rare=rare, apart=True).collect()
        got = sorted((r["doc_id"], r["n_words"], r["n_seen"], r["n_again"], round(r["log_score"], 6)) for r in rows)
        assert got == sorted((d, n, seen, again, round(score, 6)) for (d, _), (n, score, seen, again) in zip(many, plain_backoff_apart([t for _, t in many]), strict=True))
    (alone,) = lm.backoff_scores(docs.filter("doc_id = 6"), apart=True).collect()
    assert alone["n_seen"] == 0 and alone["log_score"] == pytest.approx(2 * math.log(0.4))
    assert lm.backoff_scores(empty_docs(spark), apart=True).count() == 0 and len(lm.backoff_scores(odd_docs(spark), apart=True).collect()) == len(ODD) + 3
    with pytest.raises(ValueError):
        lm.backoff_scores(docs, docs, apart=True)


def test_spellings_never_begin_another(spark):
    words = [bytes([x]) * n for x in (0x00, 0x7F, 0x80, 0xC0, 0xFF) for n in (1, 2, 126, 127, 300)]
    s = lm.Spelling.of([b"w%d" % i for i in range(20_000)])
    codes = sorted([*s.common.values(), *map(s.spell, words)])
    assert len(set(codes)) == len(codes) and not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
    pairs = [(bytearray(a + b"\x85\x01"),) for a in map(s.spell, [b"w3", b"w19000", *words])]
    assert {bytes(r[0]) for r in spark.createDataFrame(pairs, "c binary").select(lm.after_first(F.col("c"))).collect()} == {b"\x85\x01"}


def test_trigrams_travel_in_few_bytes_and_come_back(spark):
    """Rows of spelt trigrams took 29 bytes each in the shuffle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    said = Counter(w for r in docs.collect() for w in (r["text"] or "").encode().lower().split())
    words = [w for w, n in said.most_common() if n > 2]
    known = lm.Known(words, np.array([0, 0, *(said[w] for w in words)]), np.zeros(len(words) + 3, bool), [])
    rows = lm.dealt(docs, known, 4, True, True, True).collect()
    n = sum(len(lm.unpack(r["size"], r["block"])[0][5]) for r in rows)
    assert {r["part"] for r in rows} == set(range(4)) and sum(len(r["block"]) for r in rows) < 14 * n
    arrays = [np.array(x, np.int64) for x in ([], [0], [5, 1 << 20, 3], [7, (5 << 33) + 1], [-3, 4])]
    _, size, block = lm.pack(0, arrays, [b"a", b""])
    back, rare = lm.unpack(size, block)
    # An id beyond 32 bits or below 0 comes back whole, also beside others.
    assert [x.astype(np.int64).tolist() for x in back] == [x.tolist() for x in arrays] and rare == [b"a", b""]
    assert np.concatenate(back[2:4]).dtype == np.int64


def test_backoff_of_awkward_rows(spark):
    rows = lm.backoff_scores(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 3
    assert {r["doc_id"]: r["mean_score"] for r in rows}[1] is None and {r["doc_id"]: r["n_words"] for r in rows}[10] == 30_000
    assert lm.backoff_scores(empty_docs(spark)).count() == 0 and lm.backoff_scores(odd_docs(spark), empty_docs(spark)).count() == len(ODD) + 3
    assert len(lm.backoff_scores(odd_docs(spark), least=3).collect()) == len(ODD) + 3


# Pieces


def test_pieces_are_lossless_and_repeatable(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.digest(odd_docs(spark), path).collect()
    assert len(rows) == len(ODD) + 3 and all(r["lossless"] for r in rows)
    s = pieces.PieceSampler(path)
    one, many = s.encode([5], ["some words here"]), s.encode([4, 5, 6], ["x", "some words here", ""])
    assert one[0] == many[1] and many[2] == b""
    assert len({s.encode([k], ["some words here"])[0] for k in range(30)}) > 5
    assert pieces.digest(empty_docs(spark), path).count() == 0


def plain_pieces(s, key, text):
    """One lattice over the whole text, place by place, with the same draws."""
    line = " " + text if text else ""
    ids = {b: i for i, b in enumerate(s.bytes_of) if s.score[i]}
    arcs, alpha = [[] for _ in range(len(line) + 1)], [0.0] + [-math.inf] * len(line)
    for end in range(1, len(line) + 1):
        for start in range(max(0, end - s.widest), end):
            if (i := ids.get(line[start:end].encode())) is not None and "▁" not in line[start:end]:
                arcs[end].append((start, [i], s.score[i]))
        if not any(start == end - 1 for start, *_ in arcs[end]):
            raw = line[end - 1].encode()
            arcs[end].append((end - 1, [int(s.byte_id[b]) for b in raw], len(raw) * s.byte_weight))
        x = [alpha[start] + w for start, _, w in arcs[end]]
        alpha[end] = max(x) + math.log(sum(math.exp(v - max(x)) for v in x))
    at, out = len(line), []
    while at:
        z = (key + (at + 1) * 0x9E3779B97F4A7C15) % 2**64
        u = float(pieces._scramble(np.array([z], np.uint64))[0] >> np.uint64(11)) * 2.0**-53
        upto = 0.0
        for start, drawn, w in arcs[at]:
            upto += math.exp(alpha[start] + w - alpha[at])
            if upto > u:
                break
        out[:0] = drawn
        at = start
    return out


def test_pieces_match_a_plain_lattice(texts):
    """Words of any length, Chinese, spaces and repeated lines: no cut but where no piece crosses."""
    path = tokenizer_path("piece_bpe_32k.model")
    said = [t[:3000] for t in list(texts.values())[:40]] + ["x" * 700, "abcdefghij" * 60, "https://" + "aXq9/" * 100, "汉字编码" * 120, " " * 300 + "a" + " " * 40, "the" * 100 + "\n\n  " + "é" * 90, "a▁b", *[t for t in ODD if t and len(t) < 6000]]
    keys = [i * 7919 for i in range(len(said))]
    for s in (pieces.PieceSampler(path), pieces.PieceSampler(path, stretch=20, window=17, slice_chars=64)):
        for key, text, got in zip(keys, said, s.encode(keys, said), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain_pieces(s, key, text), text[:40]
            assert s.decode(got) == text


def test_pieces_of_clashing_names(spark):
    df = spark.createDataFrame([("k", "some text", 1)], "ids string, text string, decoded int")
    got = pieces.decode(pieces.encode(df, "ids", "text", tokenizer_path("piece_bpe_32k.model")), "ids", tokenizer_path("piece_bpe_32k.model"), "back").first()
    assert got["key"] == "k" and got["back"] == "some text"


def test_pieces_follow_path_weights():
    s = pieces.PieceSampler(tokenizer_path("piece_bpe_32k.model"))
    known = {b: i for i, b in enumerate(s.bytes_of) if s.score[i]}
    paths = []

    def walk(at, ids, weight, text=" hello"):
        if at == len(text):
            paths.append((tuple(ids), weight))
        for end in range(at + 1, len(text) + 1):
            i = known.get(text[at:end].encode())
            if i is not None:
                walk(end, [*ids, i], weight + s.score[i])

    walk(0, [], 0.0)
    total = sum(math.exp(w) for _, w in paths)
    n = 20_000
    seen = Counter(tuple(np.frombuffer(x, "<u4").tolist()) for x in s.encode(list(range(n)), ["hello"] * n))
    assert sum(seen[p] for p, _ in paths) == n
    assert max(abs(seen[p] / n - math.exp(w) / total) for p, w in paths) < 0.015


# Exact top-k


def test_top_k_with_ties_gaps_and_large_values(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=5)]) for i in range(0, 400)]
    rows += [(1000 + i, [1.0] * 5) for i in range(30)] + [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 5), (2003, [float("inf")] * 5), (None, [1.0] * 5), (2004, [1e10] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = topk.search(topk.whole_vectors(df), F.col("vec_id") % 100 == 0, block_rows=16, group_blocks=3, bound_blocks=4, query_rows=2, query_chunk=1, seed_queries=1).collect()
    fine = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and i not in (2000, 2001, 2002, 2003)}
    for q in [i for i in fine if i % 100 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q))[:10]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, -s) for s, i in want]
    assert topk.search(topk.whole_vectors(df.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_sends_only_blocks_that_can_answer(spark, monkeypatch):
    """Vectors in clusters by id: a query's chunk meets few blocks, and repeated vec_ids are candidates each."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in 3 * np.eye(8)[i // 100] + rng.normal(size=8) / 50]) for i in range(800)] + [(5, [9.0] + [0.0] * 7)] * 2
    kept, cut = [], topk.cut
    monkeypatch.setattr(topk, "cut", lambda df, tag: kept.append((tag, cut(df, tag))) or kept[-1][1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(topk.whole_vectors(df), F.col("vec_id") % 100 == 50, block_rows=20, group_blocks=2, query_rows=1, query_chunk=1).collect()
    pairs = dict(kept)["pairs"].count()
    assert pairs < 0.3 * 8 * 41
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 50][:2] == [5, 5]
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for q, v in fine:
        if q % 100 == 50:
            want = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q)[:10]
            assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


# Quality


def test_quality_counts_match_a_plain_version(docs, texts):
    rows = {r["doc_id"]: r for r in quality.rules(docs).collect()}
    for d, t in texts.items():
        words, seen, again = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])


def test_quality_bands(spark):
    import random

    rng = random.Random(0)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(2000))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(40)) for _ in range(300))
    rows = [(1, prose), (2, " ".join(f"w{i % 90}x{i % 7}" for i in range(3000))), (3, noise), (4, prose[:400])]
    kept = {r["doc_id"]: r["kept"] for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: kept[3], 4: True}
    assert quality.rules(odd_docs(spark)).count() == len(ODD) + 3 and quality.rules(empty_docs(spark)).count() == 0


def test_quality_bands_follow_the_corpus(spark):
    """Repetitive and incompressible texts that pass the base rule go at every length, and every verdict is that of a plain version."""
    import math
    import random
    import statistics

    import zstandard

    rng = random.Random(1)
    stock = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    noise = lambda n: " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(n))

    def drone(n):  # few words, no window of three twice
        few, out, seen = stock[:24], stock[:2], set()
        while len(out) < n:
            w = rng.choice(few)
            if (out[-2], out[-1], w) not in seen or rng.random() < 0.02:
                seen.add((out[-2], out[-1], w))
                out.append(w)
        return " ".join(out)

    texts = {i: prose(rng.choice([90, 180, 370, 740, 1500])) for i in range(400)}
    bad = {}
    for n in (150, 400, 800, 1600):
        bad[1000 + n], bad[5000 + n] = drone(n), noise(n)
    texts |= bad | {9000: prose(60), 9001: prose(7000)}
    texts |= {10000 + i: texts[3] for i in range(500)}  # copies don't set the limits
    got = {r["doc_id"]: r for r in quality.rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert not any(got[d]["base_failed"] for d in texts)
    assert {d for d in texts if not got[d]["kept"]} == set(bad)

    share = lambda raw: len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(raw)) / len(raw)
    chunks = lambda raw: [raw[i : i + 4096] for i in [*range(0, len(raw) - 4096, 4096), len(raw) - 4096]] if len(raw) > 4096 else []
    raws = {d: t.encode() for d, t in texts.items()}
    classes, pieces_ = {}, set()
    for raw in raws.values():
        classes.setdefault(int(math.log2(len(raw)) + 1e-9), set()).add((len(raw), share(raw)))
        pieces_ |= {(len(raw), share(c)) for c in chunks(raw)}

    def fence(values):
        v = sorted(round(x, 3) for _, x in values)
        at = lambda p: v[math.ceil(p * len(v)) - 1]
        far = 3 * max(at(0.75) - at(0.25), 0.03 * at(0.5))
        return at(0.25) - far, at(0.75) + far

    points = {round(2 ** (k + 0.5)): fence(c) for k, c in classes.items() if len(c) >= 30}
    wide = quality.Bands()
    points |= {s: wide.limits(s) for s in wide.sizes if not min(points) / 2 < s < 2 * max(points)}
    line = sorted(points)

    def limits(size):
        lo = max((s for s in line if s <= size), default=line[0])
        hi = min((s for s in line if s >= size), default=line[-1])
        part = 0 if lo == hi or size <= line[0] else (math.log(size) - math.log(lo)) / (math.log(hi) - math.log(lo))
        return [a + part * (b - a) for a, b in zip(points[lo], points[hi], strict=True)]

    inner = fence(pieces_) if len(pieces_) >= 30 else wide.limits(4096)
    assert statistics.median(x for _, x in pieces_) > inner[0]
    for d, raw in raws.items():
        low, high = limits(len(raw))
        out = [not inner[0] <= share(c) <= inner[1] for c in chunks(raw)]
        assert got[d]["kept"] == (low <= share(raw) <= high and sum(out) <= 0.34 * len(out)), d


def test_quality_chunks_cover_every_byte(spark, texts):
    prose = " ".join(t for t in texts.values() if len(t) < 3000).encode().decode("ascii", "ignore")
    again = "this one sentence comes again. " * 500
    rows = [(1, prose[:4400] + again[:3700]), (2, prose[:8192] + again[:4000]), (3, prose[:4096]), (4, prose[:4097]), (5, prose[:8192]), (6, prose[:12287])]
    got = {r["doc_id"]: (r["n_chunks"], r["bad_chunks"]) for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 1), 2: (3, 1), 3: (0, 0), 4: (2, 0), 5: (2, 0), 6: (3, 0)}
    assert not quality.rules(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()["kept"]


# Toxicity


def test_samples_hold_rows_of_one_id_or_none_to_their_bound(spark):
    from tidemark.llm.common import sampled

    rows = [(None, "same words", "en", i % 2) for i in range(5000)] + [(7, "other words", "en", i % 2) for i in range(5000)] + [(i, f"text {i}", "de", 0) for i in range(5000)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    number = F.monotonically_increasing_id().alias("row")
    kept = sampled(many.select("*", number), 1500)
    got = {r[0]: r[1] for r in kept.groupBy("text").count().filter("count > 1").collect()}
    assert 1300 < kept.count() < 1700 and all(350 < n < 650 for n in got.values()) and len(got) == 2
    assert sampled(many.select("*", number), 15000).count() == 15000
    assert language.train(many, sample=1500).languages == ("de", "en")
    insults = spark.createDataFrame([(7, f"you utter moron {i} a", 1) for i in range(5000)] + [(None, f"a quiet day {i}", 0) for i in range(5000)], "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(insults, sample=1000)
    assert "moron" in lexicon.words or any("moron".startswith(s) for s in lexicon.stems)


def test_grammar_weighs_clauses():
    s = toxicity.Scorer(toxicity.Lexicon({"moron": 6.0}, {"lowei": 6.0}))
    weight = lambda t: s.score(t)[1]
    assert weight("a moron.") == 6 and weight("you are a moron.") > 6 and weight("not a moron.") < 2 and weight("it said moron.") < 3
    assert weight("Loweischaft") == 6 and weight("lowei") == 0 and weight("kill time") == 0 and weight("i kill you. you i kill") > 5
    assert weight("not good. moron") == 6


def test_grammar_finds_targets_after_a_threat_or_insult():
    s = toxicity.Scorer(toxicity.Lexicon({"moron": 6.0}))
    weight = lambda t: s.score(t)[1]
    assert weight("i will kill you") == weight("you kill") == 6 and weight("we are going to hurt them") == 6 and weight("kill or hurt you") == 12
    assert weight("moron, you") == weight("you moron") == weight("you moron, you") == pytest.approx(7.8)
    assert weight("i will not kill you") == pytest.approx(0.6) and weight("it said kill you") == pytest.approx(2.4)
    assert weight("kill a b c you") == 6 and weight("kill a b c d you") == 0 and weight("kill. you") == 0


def test_grammar_matches_plain_rules(texts):
    """Every word against the words around it, without a machine of states."""
    import random

    s, rng, kinds = toxicity.Scorer(toxicity.Lexicon({"moron": 6.0, "fool": 3.0}, {"lowei": 5.0})), random.Random(5), {w: k for k, ws in toxicity.WORDS.items() for w in ws.split()}
    weigh = lambda w: s.lexicon.words.get(w) or (5.0 if w.startswith("lowei") and w != "lowei" else 6.0 if kinds.get(w) == toxicity.THREAT else 0.0)
    pool = ["moron", "fool", "loweix", "lowei", "kill", "matar", "you", "him", "not", "nicht", "said", "dit", "house", "tree", "or", ".", "\n", ";"]
    said = [" ".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400)] + [t[:2000] for t in texts.values()]
    for text in said:
        total = 0.0
        for clause in re.split(r"[.!?;:\n]+", text.lower()):
            words = re.findall(r"[^\W\d_]+", clause)
            kind = [toxicity.INSULT if weigh(w) and kinds.get(w) != toxicity.THREAT else kinds.get(w) for w in words]
            for i, w in enumerate(words):
                target = toxicity.TARGET in kind[max(0, i - 4) : i] + kind[i + 1 : i + 5]
                negated = toxicity.NEGATION in kind[max(0, i - 3) : i]
                reported = toxicity.REPORT in kind[:i]
                threat = kind[i] == toxicity.THREAT
                total += weigh(w) * ((1.0 if threat else 1.3) if target else 0.0 if threat else 1.0) * ((0.1 if threat else 0.25) if negated else 1.0) * (0.4 if reported else 1.0)
        assert s.score(text)[1] == pytest.approx(total, rel=1e-9, abs=1e-12), text


def test_one_word_said_without_end_weighs_little():
    found = toxicity.features("for " * 3000 + "wordy wordy")
    assert found["=for"] == pytest.approx(math.sqrt(3000)) and found["word*"] == found["=wordy"] == pytest.approx(math.sqrt(2))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    d = d.join(labels.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.detect(d, labels).join(labels, "doc_id").filter("held_out").collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(hit) >= 0.9 and np.mean(clean) < 0.01 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(3, 1, None), (5, 1, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.detect(odd_docs(spark), labels).count() == len(ODD) + 3
    assert toxicity.detect(empty_docs(spark), labels.limit(0)).count() == 0


# Shared helpers and the pipeline


def test_attach_keeps_every_row_of_hot_keys(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id")).cast("long").alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = attach(left, right, "k", "n", hot_keys=10)
    assert out.count() == 3000 and out.filter("v = k * 2").count() == 3000


def test_attach_by_a_binary_key(spark):
    left = spark.range(300).select("id", F.when(F.col("id") < 150, F.lit("hot")).otherwise(F.col("id").cast("string")).cast("binary").alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k").cast("string"))
    assert attach(left, right, "k", "n", hot_keys=10).filter("v = CAST(k AS string)").count() == 300


@pytest.mark.parametrize("parts", [3, None])
def test_gapless_numbers(spark, parts):
    df = spark.range(500).select((F.col("id") % 3).alias("p"), "id", F.lit(1).alias("_bucket"))
    rows = gapless(df, ["p"], ["id"], "n", 167, parts, cell_rows=20).collect()
    for p in range(3):
        mine = [r["n"] for r in rows if r["p"] == p]
        assert sorted(mine) == list(range(len(mine)))


@pytest.mark.parametrize(("groups", "lengths", "copies"), [(25, (5, 300), (1, 7)), (2, (150, 200), (150, 200))])
def test_near_copies_by_overlap_match_all_pairs(spark, groups, lengths, copies):
    """Of each component under a Jaccard similarity of 0.8 on five-word shingles, or two fingerprint bits, one text stays; no other goes."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(*lengths))]
        for _ in range(rng.randint(*copies)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):  # edits that land on both sides of the threshold
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts)] = " ".join(copy)

    def sets(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held, prints, linked = {i: sets(t) for i, t in texts.items()}, {i: plain_fingerprint(t) for i, t in texts.items()}, 0
    for i in texts:
        for j in range(i):
            both = len(held[i] & held[j])
            if 5 * both >= 4 * (len(held[i]) + len(held[j]) - both) or (prints[i] ^ prints[j]).bit_count() <= 2:
                linked += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(frame).select("doc_id").collect()}
    assert linked > 20
    assert kept == {i for i in texts if find(i) == i}


def test_pipeline_stages(spark, sf_dir, docs, texts):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "near_dedup", "packing"]
    kept = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        before, after = kept.count(), out.count()
        assert 0 < after <= before, name
        kept = out
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    prints = [(d, plain_fingerprint(texts[d])) for d in left]
    assert all(a == b for a, b in plain_components(prints).items())
    packed = P.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left


def test_pipeline_stages_on_awkward_and_empty_rows(spark, sf_dir):
    import corpus_pipeline as P

    for frame in (odd_docs(spark), empty_docs(spark)):
        for _, stage in P.STAGES:
            out = stage(spark, frame, sf_dir)
            out.count()


def test_pairs_of_near_copies_that_are_too_unlike_never_become_rows(spark):
    """300 copies of a text, each with three words of its own: nearly all meet, few are 0.8 alike, and few go on to be compared."""
    from tidemark.llm import overlap

    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(300):
        mine = list(words)
        for n, at in enumerate(rng.sample(range(10, 140), 3)):
            mine[at] = f"own{i}x{n}"
        rows.append((i, overlap.set_key(overlap.shingles(" ".join(mine), 5)), i, " ".join(mine)))
    texts = spark.createDataFrame(rows, "fp long, key long, row long, text string")
    sets = [set(overlap.shingles(r[3], 5).tolist()) for r in rows]
    near = {(rows[i][1], rows[j][1]) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    groups = overlap.buckets(texts, 5, 0.8)
    met = {tuple(r) for r in overlap.candidates(overlap.outlined(groups, texts, 5), 0.8).collect()}
    assert {(min(p), max(p)) for p in near} <= met and len(met) < 0.1 * 300 * 299 / 2
