"""The pipeline against a brute-force version of every stage, and its edges."""

from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, langid, mixing, packing, quality, simhash
from tests import duck
from tests.llm.test_operators import SCHEMA, awkward, brute_likelihood, union_find


def test_against_brute_force(spark, small):
    docs = common.table(spark, small, "documents")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        before = docs if not outs else outs[-1]
        outs.append(common.materialize(stage(spark, before, small), "stage"))
        if len(outs) < len(corpus_pipeline.STAGES):
            assert outs[-1].columns == docs.columns
    kept = [Counter(r.doc_id for r in o.select("doc_id").collect()) for o in outs]

    # 1: the same rules in SQL
    sql = quality.duckdb_sql("documents", "SELECT doc_id FROM kept")
    assert kept[0] == Counter(duck.run(sql, small).doc_id.tolist()) and sum(kept[0].values()) < docs.count()

    # 2: every word's likelihood as a sum over segmentations, one by one
    rows = outs[0].select("doc_id", "text", "lang").collect()
    model = langid.train(outs[0])
    known, prob, memo = {p: i for i, p in enumerate(model["pieces"])}, np.exp(model["logp"]), {}
    want = Counter()
    for r in rows:
        words = Counter(regex.findall(r"\p{L}+", r.text.lower()))
        score = np.zeros(len(model["langs"]))
        for w, n in words.items():
            if w not in memo:
                memo[w] = np.array([brute_likelihood(w, known, prob[:, j], len(known) + 256) for j in range(len(model["langs"]))])
            score += n * memo[w]
        if words and (score.max() - score[model["langs"].index(r.lang)]) / sum(words.values()) <= langid.MARGIN:
            want[r.doc_id] += 1
    assert kept[1] == want

    # 3: all pairs of fingerprints
    fps = {r.doc_id: np.array([r.hi, r.lo]).view(np.uint64) for r in simhash.fingerprints(outs[1]).collect()}
    at = sorted(fps)
    roots = union_find([(a, b) for i, a in enumerate(at) for b in at[:i] if np.bitwise_count(fps[a] ^ fps[b]).sum() <= simhash.K], at)
    assert set(kept[2]) >= set(roots.values()) and len(kept[2]) <= len(set(roots.values())) + 2 and max(kept[2].values()) == 1

    # 4: the same positions in SQL, and the order of the files
    want = duck.run(mixing.ORACLE, documents=outs[2].select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    assert kept[3] == Counter(want.doc_id.tolist())
    order = {i: sorted(g.position) for i, g in want.groupby("doc_id")}
    first = [order[r.doc_id][0] for r in corpus_pipeline.STAGES[3][1](spark, outs[2], small).select("doc_id").collect() if len(order[r.doc_id]) == 1]
    assert first == sorted(first)

    # 5: every byte once, no sequence too long, and few of them
    cut = Counter()
    for r in outs[3].select("doc_id", F.octet_length("text").alias("n")).collect():
        n = r.n + 1
        for piece in range(-(-n // packing.CAPACITY)):
            cut[r.doc_id, piece, min(packing.CAPACITY, n - piece * packing.CAPACITY)] += 1
    packed = outs[4].collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in packed) == cut
    spans = defaultdict(list)
    for r in packed:
        spans[r.sequence].append((r.seq_offset, r.length))
    for parts in spans.values():
        parts.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= packing.CAPACITY
    assert len(spans) <= 1.05 * sum(r.length for r in packed) / packing.CAPACITY + 3

    # the whole of it
    whole = corpus_pipeline.run(spark, small).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in whole) == cut


def test_packing_keeps_the_order_of_training(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 4, raising=False)
    rng = np.random.default_rng(1)
    rows = [(int(i), "x" * int(rng.integers(0, 20_000))) for i in rng.permutation(150)]
    rows += [(i, "y" * 300) for i in (1000, 1001, 1000, 1002, 1000)] + [(None, None)]  # copies in one stretch
    docs = common.materialize(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).union(spark.createDataFrame([(-1, "z" * 70_000)], "doc_id long, text string")), "order")
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    begin, at = {}, 0
    for i, t in [*rows, (-1, "z" * 70_000)]:
        begin.setdefault(i, at)
        at += len(t or "") + 1
    stretches, spans = defaultdict(set), defaultdict(list)
    for r in got:
        spans[r.sequence].append((r.seq_offset, r.length, r.doc_id))
        if r.doc_id not in (1000, 1001, 1002):
            stretches[r.sequence].add((begin[r.doc_id] + r.start) // (4 * packing.CAPACITY))
    assert all(len(v) == 1 for v in stretches.values())
    numbers = [min(stretches[s]) for s in sorted(stretches)]
    assert numbers == sorted(numbers) and numbers[-1] > 30
    assert sorted(spans) == list(range(len(spans))) and sum(r.length for r in got) == at
    for parts in spans.values():
        parts.sort(key=lambda x: x[:2])
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(parts[-1][:2]) <= packing.CAPACITY
        assert max(Counter(x[2] for x in parts).values()) == 1


def test_sequences_follow_the_curriculum(spark, monkeypatch):
    """Shares of sources in windows of sequences are those of the default schedule."""
    monkeypatch.setattr(packing, "STRETCH", 4)
    size = {"a": 6000, "b": 1500, "c": 500}
    docs = spark.createDataFrame([(i * 3 + j, "x" * 700, "en", s, 700) for j, (s, n) in enumerate(size.items()) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = common.materialize(corpus_pipeline.STAGES[3][1](spark, docs, ""), "mixed")
    got = corpus_pipeline.STAGES[4][1](spark, mixed, "").toPandas()
    assert not got.duplicated(["doc_id", "piece", "position"]).any() and got.duplicated(["doc_id", "piece"]).any()
    got["source"] = got.doc_id.map({i * 3 + j: s for j, (s, n) in enumerate(size.items()) for i in range(n)})
    natural, root = ({s: f(n) / sum(map(f, size.values())) for s, n in size.items()} for f in (float, lambda n: n**0.5))
    last = got.sequence.max() + 1
    for w in range(8):
        cut = got[(got.sequence >= w * last / 8) & (got.sequence < (w + 1) * last / 8)]
        t = (w + 0.5) / 8
        for s in size:
            want = natural[s] + max(0.0, t - mixing.HOLD) / (1 - mixing.HOLD) * (root[s] - natural[s])
            assert abs(cut[cut.source == s].length.sum() / cut.length.sum() - want) < 0.03


def test_pipeline_of_awkward_rows(spark):
    """Nulls, blanks, long texts, repeated rows, ties and clashing columns through all stages."""
    plain = [(100 + i, " ".join(f"{w}{'abcdefghij'[(i * 7 + j) % 10]}" for j, w in enumerate("the cat sat on a mat and ate some cake today".split())) + f" {'klmnopq'[i % 7] * (1 + i % 5)}", "en", "a", 50) for i in range(150)]
    docs = awkward(spark, extra=True)
    more = spark.createDataFrame(plain, SCHEMA)
    docs = docs.unionByName(more.select("*", *[F.lit("mine").alias(c) for c in docs.columns if c not in more.columns]))
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        stages.append(docs)
        docs = common.materialize(stage(spark, docs, ""), "awkward")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == stages[0].columns
    first, language, near, mixed = (Counter(r.doc_id for r in d.select("doc_id").collect()) for d in stages[1:])
    assert not {2, 3, 6} & set(first) and not language - first and not near - language
    assert near[1] <= 1 and set(mixed) == set(near)
    want = Counter()
    for r in stages[4].select("doc_id", F.octet_length("text").alias("n")).collect():
        want[r.doc_id] += r.n + 1
    have = Counter()
    for r in docs.collect():
        have[r.doc_id] += r.length
    assert have == want


def test_pipeline_leaves_nothing_but_its_result(spark, small):
    import os

    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and len(set(os.listdir(folder)) - before) == 1


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, ""), "none")
    assert docs.count() == 0
