import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from seqspark.llm import maxent


def test_report_against_brute_force_counts(spark, monkeypatch):
    random.seed(12)
    lexicons = [[f"{a}{k}" for k in range(40)] for a in ("en", "fr", "de")]
    rows = [(i, " ".join(random.choices(lexicons[i % 3], k=random.randint(1, 60)))) for i in range(300)]
    rows += [(300, None), (301, "  "), (302, "Unseen WORDS\x1cÉ only"), (303, "en1 " * 3000), (5, rows[5][1]), (None, "en1 fr2")]
    monkeypatch.setattr(maxent, "HEAD", 60)
    monkeypatch.setattr(maxent, "CLUSTERED", 50)
    monkeypatch.setattr(maxent, "UPDATES", 6)
    monkeypatch.setattr(maxent, "TOP", 40)
    got = maxent.report(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")).collect()
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), " "]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows), key=str)
    assert sorted(((*r[:5], round(r[5], 6)) for r in map(tuple, got)), key=str) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # language shows in the classes
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_scores_against_plain_sums(spark, monkeypatch):
    """Every score from the model's tables token by token, and all words of a context together have probability 1."""
    random.seed(13)
    lexicon = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(random.choices(lexicon, weights=[1 / (k + 1) for k in range(60)], k=random.randint(0, 30)))) for i in range(200)]
    rows += [(200, "w1 w2 never seen w1"), (201, None)]
    for name, value in {"HEAD": 30, "CLUSTERED": 25, "TOP": 10, "UPDATES": 4}.items():
        monkeypatch.setattr(maxent, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = maxent.Model(docs)
    counts = {bytes(r["word"]): r["c"] for r in model.counts.collect()}
    top = {w: i for w, i in model.head.items() if i < model.top}

    def log_word(word, one, two):
        kind = model.classes.of(word)
        near = maxent.NEAR - 1 if one is None else maxent.slot_of(model.classes.of(one), one)
        far = maxent.FAR - 1 if two is None else model.classes.of(two)
        inside = math.log10((counts.get(word, 0) + 0.5) / model.class_sum[kind]) - model.inner_sums[near, kind]
        if word in top:
            inside += model.inner[near, top[word]]
        return model.log_class[far * maxent.NEAR + near, kind] + inside

    got = {r["doc_id"]: r["score"] for r in maxent.report(docs).collect()}
    for i, text in rows:
        words = maxent.tokens((text or "").encode())
        want = sum(log_word(w, words[k - 1] if k else None, words[k - 2] if k > 1 else None) for k, w in enumerate(words))
        assert abs(got[i] - want) < 1e-3
    for one, two in ((b"w1", b"w2"), (b"w0", None), (None, None), (b"unseen", b"w3")):
        known = sum(10 ** log_word(w, one, two) for w in counts)
        near = maxent.NEAR - 1 if one is None else maxent.slot_of(model.classes.of(one), one)
        far = maxent.FAR - 1 if two is None else model.classes.of(two)
        unseen = sum(10 ** (model.log_class[far * maxent.NEAR + near, k] - model.inner_sums[near, k]) * 0.5 / model.class_sum[k] for k in range(maxent.CLASSES))
        assert abs(known + unseen - 1) < 1e-3


def test_gradients_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    n = rng.integers(0, 3, (maxent.NEAR, maxent.CLASSES))
    weights = rng.normal(size=(maxent.N_FEATURES, maxent.CLASSES)) * 0.1
    total = n.sum(axis=1, keepdims=True)
    slope = np.zeros_like(weights)
    maxent._add_features(slope, n - total * np.exp(maxent.log_classes(weights, 5)), 5)
    value = lambda: (n * maxent.log_classes(weights, 5)).sum()
    for kind in range(5):
        f = max(range(maxent._FIRST[kind], maxent._FIRST[kind + 1]), key=lambda f: abs(slope[f]).max())
        k = int(abs(slope[f]).argmax())
        before = value()
        weights[f, k] += 1e-5
        assert abs((value() - before) / 1e-5 - slope[f, k]) < 1e-2 * abs(slope[f, k]) + 0.05
        weights[f, k] -= 1e-5


def test_weights_within_classes_raise_the_likelihood():
    rng = np.random.default_rng(2)
    kind = rng.integers(0, maxent.CLASSES, 50)
    base = rng.uniform(0.001, 0.02, 50)
    rest = 1 - np.bincount(kind, base, minlength=maxent.CLASSES)
    n = rng.integers(0, 2, (3, 50 + maxent.CLASSES))
    n[0, 7] = 40
    weights, sums = maxent.inner_weights(n, base, kind, rest)
    some = np.eye(maxent.CLASSES)[kind]
    assert np.allclose(np.exp(sums), (base * np.exp(weights)) @ some + rest)
    gain = (n[:, :50] * weights).sum(axis=1) - ((n[:, :50] @ some + n[:, 50:]) * sums).sum(axis=1)
    assert gain[0] > 30 and (gain >= 0).all()


def test_empty_table(spark):
    assert maxent.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
