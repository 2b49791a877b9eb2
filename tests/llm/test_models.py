"""Language ID, language model and toxicity: held-out accuracy, exact counts, brute-force segments."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.llm import gru_lm, language_id, toxicity
from passagekit.llm.common import Scratch, fold
from passagekit.llm.queries import op2_language_id, op4_lm_scoring, op8_toxicity


# --- language ID
def test_languages_of_held_out_documents(spark, sf):
    out = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == 200 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark, clashing, empty):
    model = language_id.train(clashing.filter("lang is not null"), per_text=2, epochs=1)
    rows = language_id.predict_language(clashing, model).select("text", "language.*").collect()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    nothing = language_id.train(empty)
    assert nothing.predict(["abc", None]) == [("und", 0.0)] * 2
    assert language_id.predict_language(empty, model).count() == 0


def test_lookup_convolution_equals_the_plain_one():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 256, (6, 40)).astype(np.uint8)
    model = language_id.fit(w, np.array([0, 1] * 3), ["a", "b"], epochs=3)
    z = []
    for row in w:
        x, feats = model.embed[row], []
        for k, f in model.filters.items():
            s = np.stack([sum(x[i + j] @ f[j] for j in range(k)) for i in range(len(row) - k + 1)])
            feats.append(np.maximum(s.max(axis=0) + model.bias[k], 0))
        s = np.concatenate(feats) @ model.out + model.out_bias
        z.append(np.exp(s - s.max()) / np.exp(s - s.max()).sum())
    assert np.allclose(model.probabilities(w), z, atol=1e-4)


# --- language model
def test_lm_counts_are_exact_and_the_model_beats_the_base(spark, sf):
    out = {r["doc_id"]: r for r in op4_lm_scoring(spark, sf).collect()}
    docs = [(r["doc_id"], re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower()), r["f"] == 0) for r in spark.read.parquet(f"{sf}/documents.parquet").withColumn("f", fold("doc_id", 10)).collect()]
    c, n_docs = Counter(), sum(not h for *_, h in docs)
    for _, w, held in docs:
        if not held:
            c.update(w)
    n, v = sum(c.values()) + n_docs, len(c) + 1
    base = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    for d, w, held in docs:
        r = out[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, len(w) + 1, sum(x in c for x in w) + 1, n)
        assert r["base_score"] == pytest.approx(sum(base(c[x]) for x in w) + base(n_docs))
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in held)


def test_lm_edges(spark, clashing, empty):
    scratch = Scratch(spark, "t")
    model, counts = gru_lm.train(clashing, scratch, max_words=50)
    rows = gru_lm.score(clashing, model, counts, scratch).collect()
    assert len(rows) == clashing.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[300]["n_tokens"] == by[301]["n_tokens"] == 1 and by[300]["score"] == pytest.approx(by[301]["score"])
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] == 501) == [4, 4]
    assert gru_lm.score(empty, model, counts, scratch).count() == 0
    none, no_counts = gru_lm.train(empty, scratch)
    assert gru_lm.score(clashing, none, no_counts, scratch).count() == clashing.count()


def test_frequent_words_outside_the_sample_have_their_share_of_the_corpus(spark):
    docs = spark.createDataFrame([(k, f"g{k % 40} " * 20 + "all of them " * 4) for k in range(400)], "doc_id long, text string")
    model, counts = gru_lm.train(docs, Scratch(spark, "t"), learnt=2.0)
    c = {r["word"].encode(): r["c"] for r in counts.collect()}
    outside = sum(c[w] for w, k in zip(model.words, model.place, strict=False) if k == -2)
    assert outside > 0.4 * model.train_tokens
    p = np.exp(model.gru.log_probs(np.random.default_rng(5).uniform(-1, 1, (50, model.gru.hidden)).astype(np.float32)))
    assert np.allclose(p[:, gru_lm.LOOSE], outside / model.train_tokens, rtol=1e-4) and np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_every_training_text_is_learnt_from(spark):
    """A corpus beyond 500,000 tokens, and rows without an id: no frequent word is outside what the network learns from."""
    docs = spark.createDataFrame([(k if k % 9 else None, f"only{k} only{k} " + " ".join(f"w{(k + i * i) % 50}" for i in range(600))) for k in range(1500)], "doc_id long, text string")
    model, _ = gru_lm.train(docs, Scratch(spark, "t"))
    assert model.train_tokens > 900_000 and len(model.words) == 1550 and (model.place[:1550] >= 0).all()


def test_classes_are_balanced():
    rng = np.random.default_rng(4)
    for n, classes in ((1, 1), (7, 3), (100, 7), (1000, 64)):
        sizes = np.bincount(gru_lm._balanced(rng.normal(size=(n, 5)) + 3 * rng.integers(0, 2, (n, 1)), classes), minlength=classes)
        assert sizes.sum() == n and sizes.max() - sizes.min() <= 2
    near = np.repeat(np.eye(4), 8, axis=0) + rng.normal(0, 0.01, (32, 4))
    assert len(set(gru_lm._balanced(near, 4)[:8])) == 1


def test_probabilities_of_all_words_sum_to_one(spark):
    docs = spark.createDataFrame([(k, f"g{k % 9} some g{k % 5} of these words g{k % 3}") for k in range(60)], "doc_id long, text string")
    model, _ = gru_lm.train(docs, Scratch(spark, "t"))
    h = np.random.default_rng(5).uniform(-1, 1, (20, model.gru.hidden)).astype(np.float32)
    p, total = np.exp(model.gru.log_probs(h)), 0
    first = 0
    for k, end in enumerate(model.gru.ends):
        for w in range(first, end):
            total = total + p[:, k] * np.exp(model.gru.word_log_probs(h, np.full(20, w)))
        first = end
    assert first == len(set("some of these words".split())) + 9 and np.allclose(total + p[:, gru_lm.END] + p[:, gru_lm.RARE], 1, atol=1e-4)


def test_one_id_on_many_rows(spark):
    """All rows of one id are learnt from, on the executors, and score apart."""
    docs = spark.createDataFrame([(1, f"same id w{k % 7}") for k in range(3000)], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    model, counts = gru_lm.train(docs, scratch)
    rows = gru_lm.score(docs, model, counts, scratch).collect()
    assert len(rows) == 3000 and {r["n_known"] for r in rows} == {4} and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_a_workers_next_task_starts_from_the_rounds_parameters(spark, monkeypatch):
    """Tasks of one worker share the sent model: what one learns must not be what the next begins with."""
    import pyarrow as pa

    def sums(rows, make):
        batch = pa.RecordBatch.from_arrays([pa.array([bytes(r[0]) for r in rows.collect()], pa.binary())], ["idx"])
        (first, weight), (again, _) = make(iter([batch])), make(iter([batch]))
        assert np.array_equal(first, again)
        return first, weight

    monkeypatch.setattr(gru_lm, "_sums", sums)
    docs = spark.createDataFrame([(k, f"g{k % 9} some g{k % 5} of these words g{k % 3}") for k in range(60)], "doc_id long, text string")
    gru_lm.train(docs, Scratch(spark, "t"), rounds=2)


def test_a_rounds_part_is_that_of_the_whole_sequences():
    """Of each part of the steps only its own places are looked up; all parts are all tokens, in order."""
    rng, words = np.random.default_rng(4), 30
    net = gru_lm.Gru(9 + 12, 9, 4, ends=[0, 0, 0, 3, 8, 9, 15, 15, 20])
    model = gru_lm.LanguageModel([], np.r_[rng.permutation(20), np.full(9, -1), -2, -1], None, None, 12, net, 0.0, 0, 1.0, 0, 0.5)
    texts = [rng.integers(-1, words, n).astype(np.int32) for n in (0, 5, 40, 1, 0, 17, 0)]
    want = [np.concatenate(a) for a in zip(*map(model.sequences, texts), strict=True)]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    assert np.array_equal(np.flatnonzero(want[0] == gru_lm.END), starts)
    for lanes in (1, 3, 7):
        steps = -(-len(want[0]) // lanes)
        parts = list(model.lanes(texts, lanes, [(0, steps // 3), (steps // 3, steps)]))
        x, y, w, fresh = (np.concatenate(a).T.ravel() for a in zip(*parts, strict=True))
        n = len(want[0])
        assert all(np.array_equal(a[:n], b) for a, b in zip((x, y, w), want, strict=True))
        assert np.array_equal(np.flatnonzero(fresh[:n]), starts) and (y[n:] == -1).all() and (w[n:] == -1).all() and fresh[n:].all()


def test_words_are_split_and_told_apart_some_texts_at_once():
    import pyarrow as pa

    texts = ["  A\x0bb\tÄÖ ß\r\n", None, "", " \x0c ", "one", "x\x1cy\x85z\u00a0w x\u2003y", "İI " * 40] * 3
    found = list(gru_lm._words(pa.array(texts, pa.string())))
    words, sizes = [w for f, _ in found for w in f.to_pylist()], np.concatenate([n for _, n in found])
    want = [[w.decode() for w in (t or "").encode().lower().split()] for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words == [w for t in want for w in t]
    known = pa.array(["one", "b"], pa.string())
    assert gru_lm._numbers(pa.array(words, pa.string()), known).tolist() == [{"one": 0, "b": 1}.get(w, -1) for w in words]


def test_rows_are_added_up_by_input():
    rng = np.random.default_rng(6)
    for n, kinds in ((1, 5), (700, 3), (700, 60), (50, 400)):
        xs, parts = np.minimum(rng.zipf(1.3, n), kinds) - 1, [rng.normal(size=(n, 4)) for _ in range(3)]
        want, got = np.zeros((kinds, 12)), np.ones((kinds, 12))
        np.add.at(want, xs, np.concatenate(parts, axis=1))
        gru_lm.Gru._by_input(xs, parts, got)
        assert np.allclose(got, want)


def test_lanes_score_like_single_sequences():
    rng = np.random.default_rng(2)
    net = gru_lm.Gru(9, 7, 8, ends=[0, 0, 3, 8, 8, 8, 8])
    net.p["w"], net.p["wb"] = rng.normal(size=(8, 8)).astype(np.float32), rng.normal(size=8).astype(np.float32)
    seqs = [(rng.integers(0, 9, n), rng.integers(0, 7, n)) for n in (1, 5, 70, 200, 3, 64, 65)]
    words = [np.where(y == 2, rng.integers(0, 3, len(y)), np.where(y == 3, rng.integers(3, 8, len(y)), -1)) for _, y in seqs]
    got = net.score([a for a, _ in seqs], [b for _, b in seqs], lanes=3, window=16, words=words)
    for (x, y), w, s in zip(seqs, words, got, strict=True):
        h, want = np.zeros((1, 8), np.float32), 0.0
        for a, b, k in zip(x, y, w, strict=True):
            h, _ = net.step(net.p["x"][[a]], h)
            want += float(net.log_probs(h)[0, b]) + _word_log(net, h, k)
        assert s == pytest.approx(want, rel=1e-4)


def test_gru_gradients_lower_the_loss():
    x = np.tile(np.array([0, 1, 2, 3]), 800)
    lanes = x.reshape(8, -1).T
    net = gru_lm.Gru(4, 4, 12)
    score = lambda: net.score([x[:-1]], [x[1:]])[0] / (len(x) - 1)
    before = score()
    for _ in range(15):
        net.train(lanes[:-1], lanes[1:], np.zeros_like(lanes[1:]), window=11)
    assert before < -1 and score() > -0.1


def _word_log(net, h, word):
    if word < 0:
        return 0.0
    a, b = (0, 3) if word < 3 else (3, 8)
    s = net.p["w"][a:b] @ h[0] + net.p["wb"][a:b]
    return float(s[word - a] - np.log(np.exp(s).sum()))


def test_gru_gradients_are_the_slopes():
    """With windows as long as the text, one step's change of each weight has the sign of the measured slope."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, (12, 2)), rng.integers(0, 4, (12, 2))
    fresh = np.zeros((12, 2))
    fresh[[0, 5]] = 1
    net = gru_lm.Gru(5, 4, 6, ends=[0, 0, 3, 8])
    net.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in net.p.items()}
    w = np.where(y == 2, rng.integers(0, 3, y.shape), np.where(y == 3, rng.integers(3, 8, y.shape), -1))

    def loss():
        out = 0.0
        for lane in range(2):
            h = np.zeros((1, 6))
            for k in range(12):
                h, _ = net.step(net.p["x"][x[k, lane : lane + 1]], h * (1 - fresh[k, lane]))
                out -= net.log_probs(h)[0, y[k, lane]] + _word_log(net, h, w[k, lane])
        return out / 24

    old, slopes = {k: v.copy() for k, v in net.p.items()}, {}
    for k, v in net.p.items():
        g = np.zeros_like(v)
        for at in np.ndindex(v.shape):
            keep = v[at]
            v[at] = keep + 1e-5
            up = loss()
            v[at] = keep - 1e-5
            g[at] = (up - loss()) / 2e-5
            v[at] = keep
        slopes[k] = g
    net.train(x, y, fresh, window=12, rate=1e-6, lanes_word=w)
    for k, g in slopes.items():
        moved = net.p[k] - old[k]
        clear = np.abs(g) > 1e-4
        assert clear.any() and (np.sign(moved[clear]) == -np.sign(g[clear])).mean() > 0.98, k


# --- toxicity
def best_segments(values):
    """All maximal segments by their definition: the best segment, then the same left and right of it."""
    if not values or max(values) <= 0:
        return []
    best = max(((sum(values[a:b]), -(b - a), -a) for a in range(len(values)) for b in range(a + 1, len(values) + 1)))
    a, b = -best[2], -best[2] - best[1]
    return best_segments(values[:a]) + [(a, b - 1, best[0])] + [(x + b, y + b, s) for x, y, s in best_segments(values[b:])]


def test_segments_match_their_definition():
    rng = random.Random(7)
    for _ in range(150):
        v = [rng.choice([-3, -2, -1, 2, 3, 5]) + rng.random() / 100 for _ in range(rng.randint(1, 14))]
        got = toxicity.maximal_segments([(i, i, x) for i, x in enumerate(v)])
        assert [(a, b, pytest.approx(s)) for a, b, s in got] == best_segments(v)


def test_segments_in_linear_time():
    """Runs that rise and fall, with sinking and with rising levels: the worst case of a backward scan."""
    for down in (-2.0, -0.5, -1.0):
        runs = [(i, i, 1.0 if i % 2 else down) for i in range(200_000)]
        began = time.process_time()
        assert sum(1 for _ in toxicity.maximal_segments(runs)) >= 1
        assert time.process_time() - began < 1


def test_expectations_fit_clean_texts(spark):
    """Best segments of clean texts that training has not seen: expectations of 1 on average, and small ones as rare as they say.

    Scores are few and far between here, so how many stay below a given expectation is bounded from one side only.
    """
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(2400):
        toxic = k % 4 == 0
        words = [f"w{rng.randint(0, 300)}" if rng.random() > (0.12 if toxic else 0.03) else rng.choice(["vile", "nasty", "grotty", "mean"]) for _ in range(60)]
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    docs = spark.createDataFrame(rows[:1600], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:1600], "doc_id long, quality int, toxic int"))
    best = [min((s[3] for s in model.segments(t)[1]), default=model.k * 60) for (_, t), lab in zip(rows[1600:], labels[1600:], strict=True) if not lab[2]]
    assert 0 < model.k < 1 and 0.7 < sum(best) / len(best) < 1.4
    for e in (0.05, 0.1, 0.5):
        assert sum(x <= e for x in best) / len(best) < 1 - math.exp(-e) + 0.05


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(900):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 150))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["vile", "nasty", "grotty"]))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(lab))
    got = toxicity.score_toxicity(docs, model).join(lab, "doc_id").withColumn("held", fold("doc_id", 5) == 0).filter("held").collect()
    assert sum((r["toxicity"]["score"] >= 0.5) == r["toxic"] for r in got) >= 0.97 * len(got)
    sure = next(r for r in got if r["toxic"])
    first = sure["toxicity"]["segments"][0]
    assert any(w in ("vile", "nasty", "grotty") for w in sure["text"].split()[first["first"] : first["last"] + 1])


def test_toxicity_with_rare_labels_and_words_that_clean_texts_quote(spark):
    """Words over one in ten of whose documents are clean, though their rate in toxic ones is far higher."""
    rng = random.Random(4)
    bad = [f"vile{k}" for k in range(6)]
    rows, labels = [], []
    for k in range(3000):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 100))]
        toxic = int(rng.random() < 0.04)
        at = rng.randint(0, len(words))
        if toxic:
            words[at:at] = rng.sample(bad, 4)
        elif rng.random() < 0.1:
            words.insert(at, rng.choice(bad))
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(lab))
    held = {r[0] for r in lab.filter(fold("doc_id", 5) == 0).select("doc_id").collect()}
    got = [(model.probability(t) >= 0.5, bool(labels[d][2])) for d, t in rows if d in held]
    assert sum(a and b for a, b in got) >= 0.95 * sum(b for _, b in got)
    assert sum(a and not b for a, b in got) <= 0.01 * len(got)


def test_toxicity_keeps_what_speaks_for_clean(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 2
        words = [f"w{rng.randint(0, 99)}" for _ in range(30)] + ["vile" if toxic else "kindly"] * 2
        rows.append((k, " ".join(words)))
        labels.append((k, 1, toxic))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.weights["vile"][0] > 0 > model.weights["kindly"][0]


def test_toxicity_edges(spark, clashing, empty):
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.probability("x") < 0.5 and none.probability(None) < 0.5
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(clashing, labels)
    rows = toxicity.score_toxicity(clashing, model).select("toxicity.score").collect()
    assert len(rows) == clashing.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_toxicity_query(spark, sf):
    out = op8_toxicity(spark, sf)
    assert set(out.columns) >= {"doc_id", "held_out", "score", "predicted"}
    assert out.count() == 200 and out.filter((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0


def test_training_learns_from_every_token():
    """The last, shorter window counts, and places that fill up a lane don't."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 6, (33, 3)).astype(np.int32), rng.integers(0, 4, (33, 3))
    fresh = np.zeros((33, 3), np.int8)
    fresh[0] = 1
    nets = {}
    for name, steps, fill in (("cut", 20, 0), ("all", 33, 0), ("filled", 33, 4)):
        net = gru_lm.Gru(6, 4, 5)
        a, b, f = x[:steps].copy(), y[:steps].copy(), fresh[:steps].copy()
        if fill:
            a, b, f = (np.r_[v, np.full((fill, 3), w, v.dtype)] for v, w in ((a, 0), (b, -1), (f, 1)))
        net.train(a, b, f, window=20, rate=1e-3)
        nets[name] = net.p
    assert not np.allclose(nets["cut"]["o"], nets["all"]["o"], atol=1e-7)
    # filling changes the last window's length alone, so the same gradients come out
    assert all(np.allclose(nets["all"][k], nets["filled"][k], atol=2e-4) for k in nets["all"])
