from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pixelloom.llm import bag_minhash, lm_scoring, repeats
from pixelloom.llm import textnum as tn
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, extra string, node long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA).repartition(parts)


def docs(spark, sf=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def planted():
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(40):  # one family around a text that isn't its smallest id
        w = list(base)
        if i != 17:
            for _ in range(4):
                w[rnd.randrange(300)] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{rnd.randrange(10**6)}" for _ in range(60))) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "one two"), (203, "one two"), (204, "one  two"), (205, "two one")]
    rows += [(300, " ".join(["again"] * 50)), (301, " ".join(["again"] * 55)), (302, " ".join(["again"] * 200))]
    rows += [(400, rows[40][1]), (401, rows[40][1] + " more")]
    return rows


@pytest.mark.parametrize("kind", ["planted", "sf"])
def test_near_classes_match_all_pairs(spark, kind):
    rows = planted() if kind == "planted" else docs(spark)
    got = {r.doc_id: r for r in bag_minhash.near_dedup(frame(spark, rows)).collect()}
    want = brute.near_classes(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    if kind == "planted":
        assert got[0].class_size == 40


def test_near_dedup_of_nothing(spark):
    assert bag_minhash.near_dedup(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def test_signature_agreement_is_the_weighted_jaccard():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 1 << 44, 300, dtype=np.uint64)
    a, b = rnd.integers(0, 9, 300), rnd.integers(0, 9, 300)
    times = [bag_minhash.signatures(np.zeros((c > 0).sum(), np.int64), keys[c > 0], c[c > 0], 1, 4096)[0] for c in (a, b)]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((times[0] == times[1]).mean() - want) < 0.035


@pytest.mark.parametrize("kind", ["planted", "sf"])
def test_repeats_match_brute_force(spark, kind):
    if kind == "sf":
        rows = docs(spark)
    else:
        rnd = random.Random(3)
        letters = "abé"
        shared = ["".join(rnd.choice("xyzäw ") for _ in range(n)) for n in (49, 50, 51, 80, 120, 300)]
        rows = []
        for i in range(60):
            t = "".join(rnd.choice(shared) if rnd.random() < 0.4 else "".join(rnd.choice(letters + "cdefgh") for _ in range(rnd.randrange(90))) for _ in range(8))
            rows.append((i, t))
        rows += [(70, "a" * 400), (71, "a" * 49), (72, "a" * 50 + "b" * 60), (73, "ab" * 100), (74, None), (75, ""), (76, rows[3][1])]
        rows += [(77, "short"), (78, "short"), (60, rows[70][1] if len(rows) > 70 else "q")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeated_substrings(frame(spark, rows), block_bytes=4000 if kind == "planted" else 60_000).collect()}
    assert got == brute.repeats(rows)


def test_repeats_of_nothing(spark):
    assert repeats.repeated_substrings(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def test_refinement_sorts_like_bytes():
    rnd = np.random.default_rng(2)
    rows = rnd.integers(0, 2, (300, 70), dtype=np.uint8)
    rows[150:] = rows[:150]
    rows[200:, 40:] = rnd.integers(0, 2, (100, 30))
    bucket = repeats.suffix_buckets(rows)
    assert bucket.shape == (300, 21)
    found = [(rows[i, p : p + 50].tobytes(), bucket[i, p]) for i in range(300) for p in range(21)]
    ordered = sorted(t for t, _ in found)
    first = {t: k for k, t in reversed(list(enumerate(ordered)))}
    assert all(first[t] == b for t, b in found)


@pytest.mark.parametrize("hot", [1, 3])
def test_strings_of_hot_anchors(spark, monkeypatch, hot):
    """Anchors of many places are settled string by string; results stay those of brute force."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(8)

    def noise(n):
        return "".join(rnd.choice("abcdeé ") for _ in range(n))

    passage = noise(150)
    rows = [(i, noise(rnd.randrange(80)) + passage[rnd.randrange(20) :] + noise(rnd.randrange(80))) for i in range(40)]
    rows += [(90, passage), (91, passage * 2), (92, None), (93, "x" * 300), (94, "x" * 200)]
    cut = repeats.repeated_substrings(frame(spark, rows), block_bytes=1500).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut} == brute.repeats(rows)


def test_lm_scores(spark):
    rows = [*docs(spark), (9001, None), (9002, ""), (9003, "Never SEEN wörds")]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, rows), block_bytes=100_000).collect()}
    one, two, context = brute.lm_counts(rows)
    held = [i for i, _ in rows if brute.held_out(i)]
    for i, t in rows:
        r, seq = got[i], brute.lm_tokens(t)
        assert r.held_out == brute.held_out(i)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(one[w] > 0 for w in seq), sum(one.values()))
        assert math.isclose(r.base_score, brute.base_score(t, one), rel_tol=1e-9)
        assert math.isfinite(r.score)
    # The interpolated model does better than the base on text it hasn't seen.
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_lm_counts_and_mixture(spark):
    rows = docs(spark)
    df = frame(spark, rows)
    one, two, context = brute.lm_counts(rows)
    weights = {}

    def keep(cells, n, types, rounds=lm_scoring.EM_ROUNDS, learn=lm_scoring.learn_weights):
        weights["w"] = learn(cells, n, types, rounds)
        weights["n"] = n.sum()
        return weights["w"]

    old, lm_scoring.learn_weights = lm_scoring.learn_weights, keep
    try:
        got = {r.doc_id: r.score for r in lm_scoring.lm_scores(df, block_bytes=50_000).collect()}
    finally:
        lm_scoring.learn_weights = old
    total, types, w = sum(one.values()), len(one), weights["w"]
    assert weights["n"] == total
    for i, t in rows[:60]:
        seq, score = brute.lm_tokens(t), 0.0
        for before, word in zip(["<start>", *seq[:-1]], seq):
            c = context[before]
            l2, l1, l0 = w[c.bit_length()]
            score += math.log10(l2 * (two[before, word] / c if c else 0) + l1 * one[word] / total + l0 / (types + 1))
        assert math.isclose(got[i], score, rel_tol=1e-9)


def test_lm_of_nothing(spark):
    assert lm_scoring.lm_scores(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def test_words_and_hashes():
    text = " a\tbb\x0bc\x1cd é\n"
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, o = tn.words(data, np.array([0, 4, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e)] == ["a", "b", "b", "c\x1cd", "é"]
    assert o.tolist() == [0, 0, 1, 1, 1]
    h = tn.span_hashes(data, s, e)
    assert h[1] == h[2] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("edges_per_task", [7, 10**6])
def test_components(spark, monkeypatch, edges_per_task):
    from pixelloom.llm import linking

    monkeypatch.setattr(linking, "EDGES_PER_TASK", edges_per_task)
    rnd = random.Random(edges_per_task)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    want = brute.classes(200, links)
    got = {r.node: r.comp for r in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for e in links for n in e if e[0] != e[1]}


ODD = [(None, "a b c d e f g h i j " * 9), (1, "a b c d e f g h i j " * 9), (2, "x " * 20000), (3, "x " * 20000), (3, "x " * 20000), (4, None), (4, None), (5, ""), (6, "\t\n "), (7, "é" * 60)]


def test_null_ids_repeated_rows_and_long_texts(spark):
    near = bag_minhash.near_dedup(frame(spark, ODD)).collect()
    assert len(near) == len(ODD)
    got = {(r.doc_id, r.class_id, r.kept) for r in near}
    assert got == {(None, None, True), (1, None, False), (2, 2, True), (3, 2, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 7, True)}
    cut = repeats.repeated_substrings(frame(spark, ODD), block_bytes=5000).collect()
    assert len(cut) == len(ODD)
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in cut} == {
        (None, 180, 0), (1, 180, 180), (2, 40000, 0), (3, 40000, 40000), (4, 0, 0), (5, 0, 0), (6, 3, 0), (7, 120, 0)}
    scored = lm_scoring.lm_scores(frame(spark, ODD), block_bytes=5000).collect()
    assert len(scored) == len(ODD) and all(math.isfinite(r.score) for r in scored)
    assert {r.n_tokens for r in scored if r.doc_id in (4, 5, 6)} == {1}


def test_families_in_blocks(spark, monkeypatch):
    """Everything left over is settled in blocks of few texts; classes stay those of all pairs."""
    from pixelloom.llm import linking

    monkeypatch.setattr(linking, "LARGE", 1)
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(300)}" for _ in range(120)]
    rows = planted()
    for i in range(80):  # copies near the threshold: many share bands, some are alike
        w = list(base)
        for _ in range(rnd.randrange(1, 6)):
            w[rnd.randrange(120)] = f"z{rnd.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(["again"] * (30 + 6 * i))) for i in range(8)]
    left = spark.createDataFrame([(7, i, i) for i, t in rows if t], "grp long, node long, comp long")
    texts = spark.createDataFrame(rows, "node long, text string")
    links = [(r.a, r.b) for r in bag_minhash.links_of_families(left, texts, block=9).collect()]
    bags = {i: brute.bag(t) for i, t in rows}
    want = {(a, b) for a in bags for b in bags if a < b and bags[a] and bags[b] and brute.similarity(bags[a], bags[b]) >= 0.8}
    assert set(links) == want and len(links) == len(want)
    got = {r.doc_id: r.class_id for r in bag_minhash.near_dedup(frame(spark, rows)).collect()}
    assert got == brute.near_classes(rows)


def test_families_link_only_within_groups(spark):
    """Alike texts of one family that share no group are no link, as in small groups."""
    rows = [(i, " ".join(f"w{k}" for k in range(60))) for i in range(3)]
    left = spark.createDataFrame([(7, 0, 0), (7, 1, 1), (8, 1, 1), (8, 2, 2)], "grp long, node long, comp long")
    links = bag_minhash.links_of_families(left, spark.createDataFrame(rows, "node long, text string"), block=2).collect()
    assert sorted((r.a, r.b) for r in links) == [(0, 1), (1, 2)]


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


def test_thue_morse_words_and_lines_stay_apart(spark):
    """A word and its complement have one polynomial hash modulo a power of two, whatever the base."""
    from pixelloom.llm import line_dedup

    swap = str.maketrans("ab", "ba")
    for n in (1024, 2048, 65536):
        x = thue_morse(n)
        y = x.translate(swap)
        rows = [(1, x), (2, y), (3, x), (7, f"{y} {y}")]
        lines = {r.doc_id: r.n_dropped for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
        assert lines == {1: 0, 2: 0, 3: 1, 7: 0}
        scored = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, rows)).collect()}
        one, _, _ = brute.lm_counts(rows)
        for i, t in rows:
            assert scored[i].n_known == sum(one[w] > 0 for w in brute.lm_tokens(t))
            assert math.isclose(scored[i].base_score, brute.base_score(t, one), rel_tol=1e-9)
        near = {r.doc_id: r.class_id for r in bag_minhash.near_dedup(frame(spark, rows)).collect()}
        assert near == {1: 1, 2: 2, 3: 1, 7: 7}


def test_texts_under_one_id_are_told_apart(spark):
    rows = [(None, "a b c d e f g"), (None, "p q r s t u v"), (None, "a b c d e f g"), (5, "p q r s t u v"), (5, "h i j k l m"), (9, "h i j k l m")]
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in bag_minhash.near_dedup(frame(spark, rows)).collect())
    assert got == sorted(
        [("None", "None", 2, True), ("None", "None", 2, True), ("None", "None", 2, True), ("5", "None", 2, False), ("5", "5", 2, True), ("9", "5", 2, False)]
    )


def test_exchange_in_two_levels(spark, monkeypatch):
    """With few ranges a level, blocks ask by way of units; results don't change."""
    from pixelloom.llm import blocks, line_dedup

    rows = docs(spark)[:120]
    df = frame(spark, rows)

    def results():
        lines = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.line_dedup(df, block_bytes=8_000).collect())
        scores = sorted((r.doc_id, r.n_known, r.train_tokens, round(r.score, 6)) for r in lm_scoring.lm_scores(df, block_bytes=8_000).collect())
        cuts = sorted((r.doc_id, r.n_removed, r.kept_sha256) for r in repeats.repeated_substrings(df, block_bytes=8_000).collect())
        return lines, scores, cuts

    plain = results()
    monkeypatch.setattr(blocks, "FAN_BITS", 3)
    assert results() == plain


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Where two words of a block share a hash, their bytes decide."""
    data = np.frombuffer(b"aa bb aa a-word-of-twenty-bytes another-long-one-of-21 bb", np.uint8)
    s, e, _ = tn.words(data, np.array([0, len(data)]))
    monkeypatch.setattr(tn, "mix", lambda x: x * np.uint64(0))
    number, first = tn.interned(data, s, e)
    texts = [data[a:b].tobytes() for a, b in zip(s, e)]
    assert [texts[first[n]] for n in number] == texts and len(first) == 4


def test_keys_of_one_hash_are_told_apart_by_proofs():
    from pixelloom.llm import blocks

    keys, proof = np.array([5, 5, 7, 5], np.uint64), np.array([2, 1, 0, 2], np.uint64)
    k, p, where = blocks.same_keys(keys, proof)
    assert (k.tolist(), p.tolist(), where.tolist()) == ([5, 5, 7], [1, 2, 0], [1, 0, 2, 1])


def test_expectation_maximisation_on_bins_is_close_to_exact(spark):
    """Weights learned from every deleted count itself, without bins, score the corpus alike."""
    rows = docs(spark)
    one, two, context = brute.lm_counts(rows)
    total, types = sum(one.values()), len(one)
    events = []
    for i, t in rows:
        if not brute.held_out(i):
            seq = brute.lm_tokens(t)
            for before, word in zip(["<start>", *seq[:-1]], seq):
                c = context[before] - 1
                events.append((c.bit_length(), (two[before, word] - 1) / c if c else 0.0, (one[word] - 1) / (total - 1)))
    bucket, p2, p1 = (np.array(x) for x in zip(*events))
    p = np.stack([p2, p1, np.full(len(p1), 1 / (types + 1))], 1)
    w = np.tile([0.4, 0.5, 0.1], (lm_scoring.BUCKETS, 1))
    for _ in range(400):
        share = w[bucket] * p
        share /= share.sum(1, keepdims=True)
        sums = np.stack([np.bincount(bucket, share[:, j], lm_scoring.BUCKETS) for j in range(3)], 1)
        seen = sums.sum(1) > 0
        w[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
    w[:, 2] = np.maximum(w[:, 2], 1e-6)
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(frame(spark, rows)).collect()}
    mine, exact, n = 0.0, 0.0, 0
    for i, t in rows:
        seq = brute.lm_tokens(t)
        for before, word in zip(["<start>", *seq[:-1]], seq):
            c = context[before]
            l2, l1, l0 = w[c.bit_length()] / w[c.bit_length()].sum()
            exact += math.log10(l2 * (two[before, word] / c if c else 0) + l1 * one[word] / total + l0 / (types + 1))
        mine += got[i]
        n += len(seq)
    assert abs(mine - exact) / n < 0.002
