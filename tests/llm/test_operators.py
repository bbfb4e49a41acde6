"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import common, ctw, jpeg, langid, mixing, packing, quality, records, registry, sharding, simhash, urlfilter
from tests import duck

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000


def awkward(spark, extra: bool = False):
    rows = [
        (1, "The cat sat on the mat, and the dog ate the cake.", "en", "a", 1), (1, "The cat sat on the mat, and the dog ate the cake.", "en", "a", 1), (2, "", "en", "a", 0), (3, None, "en", None, None),
        (None, "a null id with a text of some words in it", "en", "a", 3), (4, LONG, None, "b", len(LONG)), (5, "x" * 50_000, "en", "b", 50_000), (6, " \n\t ", None, None, 4), (7, "!!! ### ???", "de", "b", 11),
        (8, "日本語のテキスト 😀 naïve café", "en", "a", 20), (9, "same size", "en", "a", 9), (10, "same size", "en", "a", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for c in ("tessera__lang", "tessera__source", "tessera__h", "tessera__position", "key", "node", "shard", "status", "f", "n_words", "a.b", "gone"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


# ---- 1


def words_of(t):
    return [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]


def test_quality_features_by_brute_force(spark):
    docs = awkward(spark).filter("text is not null")
    got = docs.select("text", quality.features(F.col("text")).alias("f")).select("text", "f.*").collect()
    for r in got:
        w = words_of(r.text)
        chars = sum(map(len, w))
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert r.n_words == len(w)
        if w:
            assert r.symbol_pm == 1000 * len(regex.sub(r"[\p{L}\p{N}\s.,;:'\"()?-]+", "", r.text)) // chars
            assert r.upper_pm == 1000 * len(regex.findall(r"\p{Lu}", r.text)) // chars
            assert r.repeat_pm == 1000 * (len(grams) - len(set(grams))) // max(1, len(grams))
            assert r.twice_pm == 1000 * sum(a == b for a, b in zip(w, w[1:])) // max(1, len(w) - 1)
            assert r.word_len10 == 10 * chars // len(w)


def test_quality_buckets(spark):
    df = spark.range(0, 5000).select("id", quality.bucket_of(F.col("id")).alias("b")).withColumn("top", quality.top_of(F.col("b")))
    for r in df.collect():
        assert r.id <= r.top <= max(r.id, r.id * 33 / 32 + 1)
    assert df.filter("id < 64 and top <> id").count() == 0


def test_quality_keeps_plain_and_drops_junk(spark):
    rng = random.Random(0)
    plain = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(9999)) for _ in range(80)), "en", f"s{i % 3}", 0) for i in range(300)]
    junk = [(1000, "### $$$ %%% " * 40, "en", "s0", 0), (1001, "SHOUT!! " * 60, "en", "s1", 0), (1002, "again " * 200, "en", "s2", 0), (1003, "", "en", "s0", 0), (1004, None, "en", "s0", 0), (1005, " ".join(f"w{i // 2}x" for i in range(160)), "en", "s0", 0)]
    docs = spark.createDataFrame(plain + junk, SCHEMA)
    kept = ids(quality.filter_documents(docs))
    assert kept == list(range(300)) and ids(quality.quality_report(docs)) == kept


def test_quality_sql_and_edges(spark):
    docs = awkward(spark)
    kept = quality.quality_report(docs)
    want = duck.run(quality.ORACLE, documents=docs.toArrow())
    assert duck.rows(kept.toPandas()) == duck.rows(want)
    filtered = quality.filter_documents(awkward(spark, extra=True))
    assert ids(filtered) == ids(kept) and filtered.columns == awkward(spark, extra=True).columns
    assert {2, 3, 6} & set(ids(kept)) == set()
    assert quality.filter_documents(empty(spark)).count() == 0 and quality.quality_report(empty(spark)).count() == 0


# ---- 2


@pytest.mark.parametrize("capacity", [10, 64, 1000])
def test_packing_plan(capacity):
    rng = random.Random(capacity)
    for size in (0, 1, 7, 60, 3000):
        h = Counter(min(capacity, max(1, int(rng.expovariate(3 / capacity)))) for _ in range(size))
        runs = packing.plan(dict(h), capacity)
        fill, seen, spans = Counter(), Counter(), defaultdict(list)
        for length, first, n, seq, per, offset in runs.tolist():
            assert first == seen[length]
            seen[length] += n
            for i in range(n):
                fill[seq + i // per] += length
                spans[seq + i // per].append((offset + i % per * length, length))
        assert seen == h and sorted(fill) == list(range(len(fill)))
        for s, parts in spans.items():
            parts.sort()
            assert fill[s] <= capacity and all(a[0] + a[1] <= b[0] for a, b in zip(parts, parts[1:]))
        # at most a sequence for each configuration of the rounding, a group's rounding loss, and one for the small
        lower = -(-sum(k * v for k, v in h.items()) // capacity)
        assert len(fill) <= 1.25 * lower + packing.GROUPS + 2


def fewest(items, capacity):
    """The least number of sequences, by trying all placements."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= items[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - items[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [(r, j) for j, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def sequences(items, capacity):
    runs = packing.plan(dict(Counter(items)), capacity)
    return max((r[3] + -(-r[2] // r[4]) for r in runs.tolist()), default=0)


def test_packing_against_exact_packings_of_small_instances():
    rng = random.Random(11)
    more = []
    for _ in range(150):
        capacity = rng.choice([12, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        got, want = sequences(items, capacity), fewest(items, capacity)
        assert want <= got <= want + 1
        more.append(got - want)
    assert np.mean(more) < 0.1


def test_packing_against_plain_best_fit():
    rng = random.Random(12)
    for size, spread in ((300, 0.3), (2000, 0.3), (2000, 0.9), (2000, 0.05)):
        items = [min(1000, max(1, int(rng.expovariate(1 / (spread * 1000))))) for _ in range(size)]
        assert sequences(items, 1000) <= 1.03 * best_fit(items, 1000) + 3


def test_packing_groups_and_configurations():
    g = packing.linear_groups([(9, 3), (7, 5), (2, 2)], 3)
    assert [sum(n for _, n in x) for x in g] == [4, 4, 2] and g[0] == [(9, 3), (7, 1)]
    configs = packing.configurations([6, 4, 3], [10, 10, 10], 10)
    assert all(sum(a * b for a, b in zip(c, (6, 4, 3))) <= 10 for c, _ in configs)
    assert [sum(c[i] * n for c, n in configs) for i in range(3)] == [10, 10, 10]
    assert sum(n for _, n in configs) <= 15  # 10 of (6, 4) and 4 of (3, 3, 3)


def test_packing_documents(spark):
    for docs in (awkward(spark), awkward(spark, extra=True).select("doc_id", "text", "key")):
        got = packing.pack(docs, capacity=1000).toPandas()
        want = Counter()
        for r in docs.collect():
            want[r.doc_id] += len((r.text or "").encode()) + 1
        have = Counter()
        for r in got.itertuples():
            have[None if r.doc_id != r.doc_id else r.doc_id] += r.length
        assert have == want
        assert got.groupby("sequence").length.sum().max() <= 1000
        for _, g in got.sort_values("seq_offset").groupby("sequence"):
            ends = (g.seq_offset + g.length).tolist()
            assert all(a <= b for a, b in zip(ends, g.seq_offset.tolist()[1:]))
        assert (got.start == got.piece * 1000).all()
    assert packing.pack(empty(spark)).count() == 0


# ---- 3


def brute_likelihood(word, known, prob, size):
    text = langid.MARK + word
    alpha = [1.0] + [0.0] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            if text[s:e] in known:
                alpha[e] += alpha[s] * prob[known[text[s:e]]]
        if text[e - 1] not in known:
            p = 1.0
            for b in text[e - 1].encode():
                p *= prob[len(known) + b]
            alpha[e] += alpha[e - 1] * p
    return math.log(alpha[-1])


def test_language_forward_sums_all_segmentations():
    known = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "abba", "▁ab"])}
    lattice = langid.Lattice(known)
    rng = np.random.default_rng(0)
    prob = rng.dirichlet(np.ones(lattice.size), 2).T
    words = ["abba", "b", "abab", "ß", "aßb", "ab" * 15, "ab" * 40, "日本"]
    got = langid.word_scores(words, lattice, np.log(prob))
    for i, w in enumerate(words):
        for j in range(2):
            assert got[i, j] == pytest.approx(brute_likelihood(w, known, prob[:, j], lattice.size), rel=1e-9)


def test_language_fit_raises_the_likelihood():
    known = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁ab"])}
    lattice = langid.Lattice(known)
    counts = {"x": Counter({"abab": 9, "ab": 5}), "y": Counter({"bb": 9, "a": 2})}
    scores = []
    for rounds in (0, 1, 3, 8):
        langs, logp = langid.fit(counts, lattice, rounds, smoothing=1e-6)
        assert langs == ["x", "y"]
        scores.append(sum(n * langid.word_scores([w], lattice, logp)[0, j] for j, lang in enumerate(langs) for w, n in counts[lang].items()))
    assert scores == sorted(scores)


def test_language_held_out_accuracy(spark, small):
    docs = common.table(spark, small.replace("0.001", "0.01"), "documents")
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = langid.train(train)
    rows = test.select("text", "lang").collect()
    texts = pa.array([r.text for r in rows], pa.string())
    v = langid._verdict(model, langid.Scorer(model), texts, [r.lang for r in rows], langid.MARGIN)
    assert np.mean([a == r.lang for a, r in zip(v["pred_lang"], rows)]) > 0.97 and v["keep"].mean() > 0.97
    wrong = langid._verdict(model, langid.Scorer(model), texts, ["de" if r.lang != "de" else "es" for r in rows], langid.MARGIN)
    assert wrong["keep"].mean() < 0.01

    # mixtures: up to 30 % foreign words stay, 70 % go
    rng, pool = random.Random(4), defaultdict(list)
    for r in rows:
        pool[r.lang] += regex.findall(r"\p{L}+", r.text or "")
    for share, low, high in ((0.1, 0.99, 1), (0.3, 0.95, 1), (0.7, 0, 0.1), (0.9, 0, 0.01)):
        mixed, declared = [], []
        for _ in range(200):
            a, b = rng.sample(sorted(pool), 2)
            n = round(60 * share)
            mixed.append(" ".join(rng.sample(pool[b], n) + rng.sample(pool[a], 60 - n)))
            declared.append(a)
        keep = langid._verdict(model, langid.Scorer(model), pa.array(mixed), declared, langid.MARGIN)["keep"].mean()
        assert low <= keep <= high, share


def test_language_sample_is_bounded_whatever_the_ids(spark, small):
    docs = common.table(spark, small.replace("0.001", "0.01"), "documents")
    words = lambda d: {k: dict(v) for k, v in langid.sample_counts(d, 20).items()}
    want = words(docs)
    assert words(docs.withColumn("doc_id", F.lit(None).cast("long"))) == want and words(docs.withColumn("doc_id", F.lit(3))) == want
    one = docs.filter("lang = 'en'").orderBy(F.xxhash64("text")).limit(1)
    many = words(one.crossJoin(spark.range(500)).select("lang", "text"))
    assert many in ({}, words(one))


def test_language_fit_of_long_words_is_the_same_in_log_space():
    known = {p: i for i, p in enumerate(["▁", "a", "b", "ab", "▁ab"])}
    lattice = langid.Lattice(known)
    rng = np.random.default_rng(2)
    prob = rng.dirichlet(np.ones(lattice.size), 2).T
    words, weight = ["abab", "bßa"], np.array([[1.0, 2.0], [3.0, 0.0]])
    got = np.zeros_like(prob)
    for w, x in zip(words, weight):
        langid._log_expected(lattice, w, x, np.log(prob), got)
    assert np.allclose(got, langid._expected(lattice, words, weight, prob))
    langs, logp = langid.fit({"x": Counter({"ab" * 40: 3}), "y": Counter({"b": 1})}, lattice)
    assert logp[known["ab"], 0] > np.log(0.5)


def test_language_edges(spark):
    docs = awkward(spark)
    kept = ids(langid.filter_documents(docs))
    assert kept == ids(langid.language_report(docs)) and not {2, 3, 6, 7} & set(kept) and None in kept and kept.count(1) == 2
    clash = awkward(spark, extra=True)
    assert langid.filter_documents(clash).columns == clash.columns and ids(langid.filter_documents(clash)) == kept
    assert langid.filter_documents(empty(spark)).count() == 0 and langid.language_report(empty(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert ids(langid.filter_documents(unlabelled)) == kept
    assert langid.language_report(unlabelled).filter("pred_lang is not null").count() == 0


# ---- 4


def brute_ctw(texts, target, depth):
    """Pw of everything over Pw without the one occurrence, for each bit of the target, which is one of the texts."""
    cnt, seen = Counter(), defaultdict(set)

    def places(t):
        p = bytes(depth) + t
        for i in range(len(t)):
            for k in range(8):
                node, x = (1 << k) | (t[i] >> (8 - k)), (t[i] >> (7 - k)) & 1
                yield node, x, [p[i + depth - d : i + depth] for d in range(depth + 1)]

    for t in (x.encode() for x in texts):
        for node, x, contexts in places(t):
            for c in contexts:
                cnt[c, node, x] += 1
                if c:
                    seen[c[1:], node].add(c)
    memo = {}

    def pw(c, n, x=None, gone=()):
        """log Pw; without an x at the contexts of gone."""
        if c not in gone and (c, n) in memo:
            return memo[c, n]
        a, b = (cnt[c, n, y] - (c in gone and y == x) for y in (0, 1))
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        out = kt if len(c) == depth else math.log(0.5) + np.logaddexp(kt, sum(pw(q, n, x, gone) for q in seen[c, n]))
        if c not in gone:
            memo[c, n] = out
        return out

    return -sum(pw(b"", node) - pw(b"", node, x, contexts) for node, x, contexts in places(target.encode())) / math.log(2)


@pytest.mark.parametrize("depth", [3, 6])
def test_ctw_by_brute_force(spark, monkeypatch, depth):
    monkeypatch.setattr(ctw, "SLICE", 40)  # several slices
    monkeypatch.setattr(ctw, "BLOCK", 16)
    texts = ["hello wörld, hello there", "the other", "xyz " * 7, "the other", "abcdefgh abcdefgx"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, ""), (10, None), (None, "the")], "doc_id long, text string").withColumn("slice", F.lit("mine")).coalesce(2)
    got = {r.doc_id: r for r in ctw.score(docs, depth).collect()}
    for i, t in enumerate(texts):
        assert got[i].code_bits == pytest.approx(brute_ctw([*texts, "the"], t, depth), rel=1e-5)
        assert got[i].n_bytes == len(t.encode()) and got[i].bits_per_byte == pytest.approx(got[i].code_bits / got[i].n_bytes)
    assert got[1].code_bits == got[3].code_bits
    assert got[9].bits_per_byte is None and got[10].code_bits == 0 and None in got and len(got) == 8
    assert ctw.score(empty(spark), depth).count() == 0


def test_ctw_awkward_rows(spark):
    got = ctw.score(awkward(spark, extra=True)).collect()
    assert len(got) == awkward(spark).count() and sum(r.n_bytes for r in got) == sum(len((r.text or "").encode()) for r in awkward(spark).collect())


def test_lm_scoring_uses_long_contexts_and_no_byte_explains_itself(spark, small):
    docs = common.table(spark, small, "documents")
    total = lambda depth: ctw.score(docs, depth).agg(F.sum("code_bits")).first()[0]
    assert total(6) < 0.95 * total(3)
    rng = random.Random(3)
    noise = ["".join(chr(rng.randrange(33, 127)) for _ in range(200)) for _ in range(40)]
    bits = {r.doc_id: r.bits_per_byte for r in ctw.score(spark.createDataFrame(list(enumerate([*noise, noise[0]])), "doc_id long, text string")).collect()}
    assert min(bits[i] for i in range(1, 40)) > 6.4  # log2(94) = 6.55: noise can't be told from its own counts
    assert bits[0] == bits[40] < min(bits[i] for i in range(1, 40)) - 0.2  # the other copy does


def test_ctw_blocks_dont_matter(monkeypatch):
    col = pa.array(["abc", None, "", "defgh", "i"])
    whole = [(a, b, d.tobytes(), o.tolist()) for a, b, d, o in ctw.buffers(col)]
    monkeypatch.setattr(ctw, "BLOCK", 3)
    parts = list(ctw.buffers(col.slice(0)))
    assert len(whole) == 1 and b"".join(d.tobytes() for *_, d, _ in parts) == b"abcdefghi" and [p[1] for p in parts][-1] == 5
    assert [x[2] for x in [(a, b, d.tobytes()) for a, b, d, _ in ctw.buffers(col.slice(3))]] == [b"defgh", b"i"]


# ---- 5


def near_corpus(n=60, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    docs = []
    for i in range(n):
        base = [word() for _ in range(rng.randint(60, 200))]
        docs.append(" ".join(base))
        for _ in range(i % 3):
            copy = base.copy()
            for j in rng.sample(range(len(copy)), max(1, len(copy) // 40)):
                copy[j] = word()
            docs.append(" ".join(copy))
    return docs


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    texts = near_corpus()
    texts += texts[:5] + [texts[0]] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {r.doc_id: np.array([r.hi, r.lo]).astype(np.int64).view(np.uint64) for r in simhash.fingerprints(docs).collect()}
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash.K]
    roots = union_find(pairs, range(n))
    got = {r.doc_id: r.kept_doc_id for r in simhash.duplicate_pairs(docs).collect()}
    want = {i: r for i, r in roots.items() if r != i}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(want[i] == r for i, r in got.items())
    kept = ids(simhash.filter_documents(docs))
    assert kept == [i for i in range(n) if i not in got]


@pytest.mark.parametrize("n", [1, 1000, 10**5, 10**7, 10**10])
def test_simhash_tables_reach_their_recall_at_every_size_and_distance(n):
    bits, tables = simhash.plan_tables(n)
    assert n / 2**bits <= 2 * simhash.BUCKET_ROWS
    rng, values = np.random.default_rng(n % 97), simhash.sampled_bits(bits, tables)
    for d, least in ((10, 0.999), (16, 0.98), (18, 0.97), (20, 0.94), (22, 0.92)):
        a = rng.integers(0, 2, (400, 128))
        b = a.copy()
        for r in b:
            r[rng.choice(128, d, replace=False)] ^= 1
        assert ((a @ values == b @ values).any(1)).mean() >= least - 0.02


def test_simhash_finds_copies_with_a_tenth_of_their_words_replaced(spark):
    """Of the pairs within K: isolated pairs, so that no third document helps."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    texts = []
    for _ in range(200):
        base = [word() for _ in range(150)]
        copy = base.copy()
        for j in rng.sample(range(150), 15):
            copy[j] = word()
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {r.doc_id: np.array([r.hi, r.lo]).astype(np.int64).view(np.uint64) for r in simhash.fingerprints(docs).collect()}
    close = {i + 1 for i in range(0, 400, 2) if np.bitwise_count(fps[i] ^ fps[i + 1]).sum() <= simhash.K}
    got = {r.doc_id for r in simhash.duplicate_pairs(docs).collect()}
    assert len(close) > 120 and got <= close and len(got) >= 0.95 * len(close)


def planted(rng, distances):
    """Random fingerprints, and after them one at each of the distances from the first ones."""
    base = rng.integers(0, 2, (len(distances), 128))
    copy = base.copy()
    for row, d in zip(copy, distances, strict=True):
        row[rng.choice(128, d, replace=False)] ^= 1
    return np.packbits(np.concatenate([base, copy]).astype(np.uint8), axis=1).view(np.uint64)


def test_simhash_loses_no_link(spark, monkeypatch):
    """Isolated pairs at the threshold and next to it: each is found, and none beyond."""
    distances = [22] * 600 + [23] * 100 + [21] * 300
    fp = planted(np.random.default_rng(22), distances).view(np.int64)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    docs = spark.createDataFrame([(i, int(hi), int(lo)) for i, (hi, lo) in enumerate(fp)], "doc_id long, hi long, lo long")
    got = {r.doc_id: r.kept_doc_id for r in simhash.duplicate_pairs(docs).collect()}
    assert got == {1000 + i: i for i, d in enumerate(distances) if d <= simhash.K}


@pytest.mark.parametrize("k", [0, 5, 22, 30])
def test_simhash_crossing_against_brute_force(k, monkeypatch):
    """Within one side and between two, with groups of one and crowded ones, over several blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 100)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(k)
    fp = np.concatenate([planted(rng, rng.integers(0, 33, 200)), np.repeat(planted(rng, [k]), 90, axis=0)])
    of = np.concatenate([np.arange(400) // 2 * 2 + 1000, np.repeat([7, 5000], 90)])
    near = lambda i, j: simhash.distance(fp[i : i + 1], fp[j : j + 1])[0] <= k and of[i] != of[j]
    link = lambda i, j: (max(of[i], of[j]), min(of[i], of[j]))
    n = len(fp)
    u, v = simhash.crossing(fp, of, None, None, k)
    assert list(zip(u.tolist(), v.tolist())) == sorted({link(i, j) for i in range(n) for j in range(i) if near(i, j)})
    one, two = np.arange(0, n, 2), np.arange(1, n, 2)
    u, v = simhash.crossing(fp[one], of[one], fp[two], of[two], k)
    assert list(zip(u.tolist(), v.tolist())) == sorted({link(i, j) for i in one for j in two if near(i, j)})


@pytest.mark.parametrize("rows", [1, 10**3, 10**6, 10**9])
@pytest.mark.parametrize("k", [0, 5, 22, 40])
def test_simhash_segments_leave_no_pair_out(k, rows):
    cuts = simhash.cut_segments(k, rows)
    assert [a for a, _, _ in cuts] == [sum(b for _, b, _ in cuts[:i]) for i in range(len(cuts))] and sum(b for _, b, _ in cuts) == 128
    assert sum(radius + 1 for _, _, radius in cuts) == k + 1


def test_simhash_majority_and_bound():
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**62), 2**62, 500)
    off = np.array([0, 3, 200, 201, 500])
    got = simhash.simhash(h, off)
    for i in range(4):
        x = h[off[i] : off[i + 1]].view(np.uint64)
        bits = np.unpackbits(np.stack([simhash.mix(x), simhash.mix(x + np.uint64(0x9E3779B97F4A7C15))], 1).view(np.uint8).reshape(-1, 16), axis=1)
        assert (np.packbits(2 * bits.sum(0) > len(x)).view(np.uint64) == got[i]).all()
    fp = rng.integers(0, 2**63, (300, 2)).astype(np.uint64)
    c = simhash.coordinates(fp, simhash.references())
    a, b = rng.integers(0, 300, (2, 2000))
    bound = np.abs(c[:, a].astype(int) - c[:, b]).max(2).sum(0)
    assert (bound <= simhash.distance(fp[a], fp[b])).all()
    keys = np.sort(rng.integers(0, 5, 300))
    fp[1::2] = fp[::2]
    rows, roots = simhash.forest(keys, fp, simhash.references(), 10)
    want = union_find([(i, j) for i in range(300) for j in range(i) if keys[i] == keys[j] and simhash.distance(fp[i : i + 1], fp[j : j + 1])[0] <= 10], range(300))
    assert dict(zip(rows.tolist(), roots.tolist())) == {i: r for i, r in want.items() if i != r}


def test_simhash_forest_of_hot_buckets():
    """A bucket of near copies with strangers, which is finished early, and one of strangers."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, 128)
    rows = np.concatenate([np.tile(base, (500, 1)), rng.integers(0, 2, (300, 128))])
    for i in range(500):
        rows[i, rng.choice(128, rng.integers(0, 14), replace=False)] ^= 1
    rows[600:604] = rows[500:504]
    rows[600:604, :10] ^= 1
    keys = np.concatenate([np.zeros(560, int), np.ones(240, int)])
    fp = np.packbits(rows.astype(np.uint8), axis=1).view(np.uint64)
    order = np.lexsort((fp[:, 0], keys))
    keys, fp = keys[order], fp[order]
    got = simhash.forest(keys, fp, simhash.references())
    want = union_find([(i, j) for i in range(800) for j in range(i) if keys[i] == keys[j] and simhash.distance(fp[i : i + 1], fp[j : j + 1])[0] <= simhash.K], range(800))
    assert dict(zip(got[0].tolist(), got[1].tolist())) == {i: r for i, r in want.items() if i != r}


def test_simhash_long_bucket_runs_over_batches(spark):
    """A bucket larger than the rows held at a time."""
    n = 1000
    rows = spark.range(0, n).select(F.lit(7).cast("int").alias("key"), F.lit(5).cast("long").alias("hi"), (F.col("id") % 8).alias("lo"), F.col("id").alias("node"))
    found = simhash.components(simhash.bucket_edges(rows)).collect()
    assert len(found) == n - 1 and {r.root for r in found} == {0}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    nodes = {x for e in edges for x in e}
    want = {n: r for n, r in union_find(edges, nodes).items() if n != r}
    assert {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()} == want


def test_simhash_edges(spark):
    kept = ids(simhash.filter_documents(awkward(spark)))
    assert kept.count(1) == 1 and {2, 3, 6, 7, 4, 5, 8, 9} <= set(kept) and None in kept and 10 not in kept
    clash = awkward(spark, extra=True)
    assert simhash.filter_documents(clash).columns == clash.columns and ids(simhash.filter_documents(clash)) == kept
    assert simhash.filter_documents(empty(spark)).count() == 0 and simhash.duplicate_pairs(empty(spark)).count() == 0
    twice = spark.createDataFrame([(1, "one two three"), (1, "entirely other words here"), (2, "entirely other words here")], "doc_id long, text string")
    assert ids(simhash.filter_documents(twice)) == [1]


# ---- 6


def test_url_filter_by_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http{'s' if rng.random() < 0.5 else ''}://{rng.choice(['', 'www.', 'm.'])}Host{rng.randrange(40)}.org/p/{rng.randrange(30)}{rng.choice(['', '/', '#x', '?utm_source=q', '?b=2&a=1', '?a=1&b=2&ref=z'])}" for _ in range(3000)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(9001, None), (9002, ""), (9003, "/no/host")], "page_id long, url string").withColumn("key", F.lit("mine")).withColumn("a.b", F.lit("dotted"))
    listed = spark.createDataFrame([(u,) for u in urls[::7]] + [(None,), ("",)], "url string")
    canon = {r.url: r.c for r in pages.select("url", urlfilter.canonical(F.col("url")).alias("c")).collect()}
    bad = {canon[u] for u in urls[::7]}
    want = [i for i, u in enumerate(urls) if canon[u] not in bad] + [9001, 9002, 9003]
    got = urlfilter.filter_listed(pages, listed)
    assert sorted(r.page_id for r in got.collect()) == want and got.columns == pages.columns
    nothing = spark.createDataFrame([], "url string")
    assert urlfilter.filter_listed(pages, nothing).count() == pages.count()
    assert urlfilter.filter_listed(pages.limit(0), listed).count() == 0


def test_url_canonical_forms(spark):
    same = ["http://www.A.org/x/", "https://a.org/x#top", "a.org/x?utm_medium=1&ref=2", "HTTP://m.a.org:80/x", "https://user:pw@a.org:443/x/?gclid=7"]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(urlfilter.canonical(F.col("u"))).collect()}
    assert got == {"a.org/x"}


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(0, 20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = 20_000 // urlfilter.KEYS_PER_BLOCK
    blocks = {r.block: [r[f"w{i}"] for i in range(8)] for r in urlfilter.bloom_blocks(keys, n).collect()}
    probes = spark.range(0, 40_000).select("id", F.concat(F.lit("k"), "id").alias("key")).select("id", F.pmod(F.xxhash64("key"), F.lit(n)).alias("b"), *[m.alias(f"m{i}") for i, m in enumerate(urlfilter._bits(F.xxhash64("key", F.lit(1))))]).collect()
    hits = [all(blocks.get(r.b, [0] * 8)[i] & r[f"m{i}"] == r[f"m{i}"] for i in range(8)) for r in probes]
    assert all(hits[:20_000]) and sum(hits[20_000:]) < 0.02 * 20_000


# ---- 7


def test_mixing_sql_and_targets(spark, small):
    docs = common.table(spark, small, "documents")
    got = mixing.positions(docs)
    duck.same(got, mixing.ORACLE, small)
    rows = got.toPandas()
    assert set(rows.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}
    assert rows.position.is_monotonic_increasing


def test_mixing_spreads_null_ids(spark):
    docs = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.expr("repeat('x', int(id % 50))").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    got = mixing.positions(docs).toPandas()
    assert duck.rows(got) == duck.rows(duck.run(mixing.ORACLE, documents=docs.toArrow()))


def test_mixing_follows_the_schedule(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "x" * rng.randint(5, 60), "en", "a" if i % 4 else "b", 0) for i in range(4000)], SCHEMA)
    knots = spark.createDataFrame([("a", 0.0, 0.9), ("a", 1.0, 0.1), ("b", 0.0, 0.1), ("b", 1.0, 0.9)], "source string, t double, w double")
    total = 60_000
    rows = mixing.positions(docs, knots, total).toPandas()
    for lo in (0.0, 0.25, 0.5, 0.75):
        cut = rows[(rows.position >= lo * total) & (rows.position < (lo + 0.25) * total)]
        share = cut[cut.source == "a"].tokens.sum() / cut.tokens.sum()
        assert share == pytest.approx(0.9 - 0.8 * (lo + 0.125), abs=0.03)
    assert rows.tokens.sum() == pytest.approx(total, rel=0.01) and rows[rows.source == "b"].epoch.max() >= 0


def test_mixing_edges(spark):
    docs = awkward(spark)
    got = mixing.positions(docs).toPandas()
    want = duck.run(mixing.ORACLE, documents=docs.toArrow())
    assert duck.rows(got) == duck.rows(want)
    clash = awkward(spark, extra=True)
    mixed = mixing.mix_documents(clash)
    assert mixed.columns == clash.columns and mixed.count() == len(got)
    assert mixing.positions(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


# ---- 8


def test_crc32c_known_values():
    c = records.Crc32c()
    data = np.frombuffer(b"123456789" + bytes(32) + b"\xff" * 32, np.uint8)
    assert [hex(x) for x in c(data, np.array([0, 9, 41]), np.array([9, 32, 32]))] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43"]
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    poly = [0] * 256
    for i in range(256):
        x = i
        for _ in range(8):
            x = (x >> 1) ^ (records.POLY if x & 1 else 0)
        poly[i] = x
    for n in (4, 255, 256, 257, 3000):
        x = 0xFFFFFFFF
        for b in data[7 : 7 + n].tolist():
            x = (x >> 8) ^ poly[(x ^ b) & 255]
        assert int(c(data, np.array([7]), np.array([n]))[0]) == x ^ 0xFFFFFFFF


def test_records_round_trip(spark):
    docs = awkward(spark, extra=True)
    path = common.fresh_path(spark, "test-records")
    index = records.write_records(docs, path)
    coder = records.encoder(records.vocabulary_ranks(records.VOCABULARY))
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    got = records.read_records(index, path, seed=11).collect()
    assert sorted(((r.doc_id, coder.decode(r.tokens) if r.has_text else None) for r in got), key=str) == want
    assert [r.doc_id for r in got] != [r.doc_id for r in records.read_records(index, path, seed=12).collect()]
    one = index.filter("doc_id = 4")
    assert [coder.decode(r.tokens) for r in records.read_records(one, path).collect()] == [LONG]
    from pathlib import Path

    row = one.first()
    file = Path(path.removeprefix("file://").removeprefix("file:")) / "data" / row.file
    data = bytearray(file.read_bytes())
    assert int.from_bytes(data[row.offset : row.offset + 8], "little") == row.length
    data[row.offset + 40] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(one, path).collect()
    assert records.write_records(empty(spark), common.fresh_path(spark, "test-none")).count() == 0


def test_records_of_large_vocabularies_and_other_folders(spark, tmp_path):
    """Four-byte ids are read back as such without being told; files that the index doesn't name go."""
    ranks = records.vocabulary_ranks(records.VOCABULARY)
    wide = dict(ranks)
    wide["ü one more".encode()] = 70_000
    import base64

    (tmp_path / "wide.tiktoken").write_bytes(b"\n".join(base64.b64encode(k) + b" %d" % v for k, v in wide.items()))
    path = common.fresh_path(spark, "test-wide")
    data = tmp_path / "x"
    local = path.removeprefix("file://").removeprefix("file:")
    import os

    os.makedirs(f"{local}/data")
    open(f"{local}/data/part-00000-999.rec", "wb").close()
    docs = awkward(spark)
    index = records.write_records(docs, path, str(tmp_path / "wide.tiktoken"))
    assert set(os.listdir(f"{local}/data")) == {r.file for r in index.select("file").distinct().collect()}
    coder = records.encoder(wide)
    got = records.read_records(index, path).collect()
    assert sorted(((r.doc_id, coder.decode(r.tokens) if r.has_text else None) for r in got), key=str) == sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert records.file_system(str(data))[1] == records.file_system(f"file://{data}")[1] == records.file_system(f"file:{data}")[1] == str(data)
    with pytest.raises(ValueError, match="wasb"):
        records.file_system("wasb://somewhere/x")


# ---- 9


def test_jpeg_thumbnails_against_block_means():
    rng = np.random.default_rng(0)
    for t in range(24):
        h, w = (int(x) for x in rng.integers(1, 60, 2))
        p = rng.integers(0, 256, (h, w)).astype(np.uint8) if t % 2 else (np.add.outer(np.arange(h), np.arange(w)) * 3 % 256).astype(np.uint8)
        data = [lambda: jpeg.encode([p]), lambda: jpeg.encode([p], restart=4), lambda: jpeg.encode([p, p[::2, ::2], p[::2, ::2]], [(2, 2), (1, 1), (1, 1)], restart=3), lambda: jpeg.encode([p, p, p], q=8)][t % 4]()
        status, width, height, n, tw, th, thumb, hashed = jpeg.decode(data)
        assert (status, width, height, n) == ("ok", w, h, 1 if t % 4 < 2 else 3)
        got = np.frombuffer(thumb, np.uint8).reshape(th, tw)
        want = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float).reshape(-(-h // 8), 8, -(-w // 8), 8).mean((1, 3))
        assert got.shape == want.shape and np.abs(got - want).max() <= 1.6 and hashed == jpeg.thumb_hash(got)
        for cut in (3, len(data) // 3):
            assert jpeg.decode(data[:cut])[0] == "corrupt"
        assert jpeg.decode(data[:-2]) == jpeg.decode(data)  # without an end marker


def java_jpeg(spark, picture, progressive=False):
    """(bytes, decoded picture) by Java's own encoder and decoder; picture: (height, width, 3) red, green, blue."""
    jvm, gw = spark._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    h, w = picture.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 5)  # TYPE_3BYTE_BGR
    image.getRaster().setDataElements(0, 0, w, h, bytearray(np.ascontiguousarray(picture).tobytes()))
    sink = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(sink))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().close()
    data = bytes(sink.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    assert back.getType() == 5 and gw
    return data, np.frombuffer(bytes(back.getRaster().getDataBuffer().getData()), np.uint8).reshape(h, w, 3)[:, :, ::-1]


def test_jpeg_of_an_outside_encoder(spark):
    """Java's encoder has the standard Huffman tables and subsamples colours 4:2:0."""
    rng = np.random.default_rng(3)
    for h, w in ((64, 64), (37, 90), (200, 151)):
        y, x = np.mgrid[0:h, 0:w]
        picture = np.stack([(x * 3 + y) % 256, (y * 5) % 256, 128 + 100 * np.sin(x / 9)], 2) + rng.integers(-20, 20, (h, w, 3))
        data, back = java_jpeg(spark, np.clip(picture, 0, 255).astype(np.uint8))
        assert b"\x03\x01\x22\x00" in data  # three components, the first with 2 x 2 blocks a unit
        status, width, height, n, tw, th, thumb, hashed = jpeg.decode(data)
        assert (status, width, height, n) == ("ok", w, h, 3)
        luma = back @ [0.299, 0.587, 0.114]
        whole = luma[: h // 8 * 8, : w // 8 * 8].reshape(h // 8, 8, w // 8, 8).mean((1, 3))
        assert np.abs(np.frombuffer(thumb, np.uint8).reshape(th, tw)[: h // 8, : w // 8] - whole).max() <= 4
    assert jpeg.decode(java_jpeg(spark, np.zeros((20, 20, 3), np.uint8), progressive=True)[0])[0] == "unsupported"


def test_jpeg_colours_other_than_luminance_first():
    rng = np.random.default_rng(6)
    planes = [rng.integers(0, 256, (4, 5)).repeat(8, 0).repeat(8, 1).astype(np.uint8) for _ in range(4)]
    mean = lambda p: p.reshape(4, 8, 5, 8).mean((1, 3))
    adobe = lambda t: b"\xff\xee\x00\x0eAdobe\x00\x64\x00\x00\x00\x00" + bytes([t])
    tag = lambda data, t: data[:2] + adobe(t) + data[2:]
    thumb = lambda data: np.frombuffer(jpeg.decode(data)[6], np.uint8).reshape(4, 5)
    three, four = jpeg.encode(planes[:3], q=4), jpeg.encode(planes, q=4)
    grey = 0.299 * mean(planes[0]) + 0.587 * mean(planes[1]) + 0.114 * mean(planes[2])
    assert np.abs(thumb(tag(three, 0)) - grey).max() <= 1.5 and np.abs(thumb(tag(three, 1)) - mean(planes[0])).max() <= 1.5
    assert np.abs(thumb(tag(four, 0)) - grey * mean(planes[3]) / 255).max() <= 2
    assert np.abs(thumb(tag(four, 2)) - mean(planes[0]) * mean(planes[3]) / 255).max() <= 2


def test_jpeg_draws_every_entry():
    long = np.concatenate([np.zeros(64), np.ones(36)])
    assert jpeg.draw(0, long) != jpeg.draw(0, np.zeros(100)) and jpeg.decode(jpeg.draw(4, long))[0] == "ok"


def test_jpeg_edges(spark):
    good = jpeg.encode([np.arange(256, dtype=np.uint8).reshape(16, 16)])
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2")
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"GIF89a"), (5, progressive), (6, good[:60]), (None, good), (7, good.replace(b"\xff\xe0", b"\xff\xff\xe0")), (8, jpeg.encode([np.full((3000, 20), 9, np.uint8)]))]
    media = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id long, image binary").withColumn("status", F.lit("mine")).withColumn("other", F.lit(5))
    got = jpeg.decode_media(media, "image")
    assert got.columns == ["id", "other", "status", "width", "height", "components", "thumb_width", "thumb_height", "thumb", "thumb_hash"]
    status = Counter((r.id, r.status) for r in got.collect())
    assert status == Counter({(1, "ok"): 2, (2, "null"): 1, (3, "not_jpeg"): 1, (4, "not_jpeg"): 1, (5, "unsupported"): 1, (6, "corrupt"): 1, (None, "ok"): 1, (7, "ok"): 1, (8, "ok"): 1})
    assert jpeg.decode_media(media.limit(0), "image").count() == 0
    rng = np.random.default_rng(4)
    for _ in range(300):  # damaged bytes never raise
        b = bytearray(good)
        b[rng.integers(2, len(b))] = rng.integers(0, 256)
        assert jpeg.decode(bytes(b))[0] in ("ok", "corrupt", "unsupported")


# ---- 10


def test_sharding_sql_and_balance(spark, small, monkeypatch):
    docs = common.table(spark, small, "documents")
    duck.same(sharding.shards(docs), sharding.ORACLE, small)
    target = 20_000
    rows = sharding.shards(docs, target).toPandas().sort_values("start_byte")
    assert rows.shard.is_monotonic_increasing and rows.doc_id.is_monotonic_increasing
    sizes = rows.groupby("shard").n_bytes.sum()
    assert abs(sizes - sizes.sum() / (rows.shard.max() + 1)).max() <= rows.n_bytes.max()


def test_sharding_edges(spark):
    docs = awkward(spark, extra=True)
    got = sharding.shards(docs, 1000).toPandas()
    want = duck.run(sharding.ORACLE.replace(str(sharding.TARGET_BYTES), "1000"), documents=docs.toArrow())
    assert duck.rows(got) == duck.rows(want) and len(got) == docs.count()
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r.shard for r in sharding.shards(nothing).collect()} == {0}
    assert sharding.shards(empty(spark)).count() == 0


# ---- all


def test_registry():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_their_sql(spark, small, name):
    duck.same(registry.QUERIES[name](spark, small), registry.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_cover_their_table(spark, small, name):
    got = registry.QUERIES[name](spark, small)
    assert isinstance(got.toPandas(), pd.DataFrame) and got.count() > 0
