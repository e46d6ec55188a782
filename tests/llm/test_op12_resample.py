import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqspark.llm import resample
from seqspark.llm.words import Words, slices

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(lower)
    return words, words + [a + b" " + b for a, b in zip(words, words[1:])]


def brute(docs, target):
    bucket = lambda f: zlib.crc32(f) % 10000
    own, wanted = np.zeros(10000, int), np.zeros(10000, int)
    for counts, texts in ((own, [t for _, t in docs]), (wanted, target)):
        for t in texts:
            for f in features(t)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (own.sum() + 10000) / ((s + 1) * (wanted.sum() + 10000)))) for s, t in zip(own, wanted)]
    rows = []
    for i, text in docs:
        words, all_ = features(text)
        weight = sum(gain[bucket(f)] for f in all_) // len(all_) if all_ else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(all_), weight, score, len(words) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranked = {}
    for k, r in enumerate(able[: 25 * len(able) // 100], 1):
        ranked.setdefault(r[:4], []).append(k)
    return rows, ranked


def rows_of():
    rows = [(k, f"Wörd{k % 7} alpha-BETA {'gamma delta ' * (k % 13)} x{k}y. " + "tail " * (k % 29)) for k in range(300)]
    rows += [(400, None), (401, ""), (402, " ,.; "), (403, "one"), (404, "long words " * 40_000 + "q" * 3_000_000), (405, "€uro ñ"), (5, rows[5][1]), (None, "no id " * 12), (None, "no id " * 12)]
    return rows


def test_against_brute_force(spark):
    target = ["alpha beta gamma", None, "", "gamma delta gamma delta", "gamma delta gamma delta"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows_of()], "doc_id long, text string, rank int, place int").repartition(6)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, bench).collect()
    want, ranked = brute(rows_of(), target)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score")) for r in got), key=str) == sorted((r[:4] for r in want), key=str)
    drawn = {}
    for r in got:
        if r["rank"] is not None:
            drawn.setdefault((r["doc_id"], r["n_features"], r["weight"], r["score"]), []).append(r["rank"])
    assert {k: sorted(v) for k, v in drawn.items()} == ranked
    assert sorted(x for v in drawn.values() for x in v) == list(range(1, len(got) and sum(len(v) for v in ranked.values()) + 1))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resample.resample(docs, some.select("text")).collect() == []
    assert [r["weight"] for r in resample.resample(some, docs.select("text")).collect()] == [math.floor(1000 * math.log(10003 / 20000))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=300), min_size=1, max_size=40))
def test_crc_matrices(words):
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    got = resample.crc32_slices(np.frombuffer(b"".join(words), np.uint8), starts, sizes)
    assert got.tolist() == [zlib.crc32(w) for w in words]


@pytest.mark.parametrize("orders", [1, 2, 3])
@pytest.mark.parametrize("size", [10, 40, 1 << 20])
def test_long_texts_in_parts(orders, size):
    texts = [b"a bb ccc dddd " * 30, b"", None, b"one two three", b"x", b" ,", "Ünï-Code A1".encode() * 9]
    seen = [[] for _ in texts]
    n = np.zeros(len(texts), int)
    for words in slices(texts, orders - 1, size):
        n += np.bincount(words.text[words.new], minlength=len(texts))
        for t, b in zip(*(x.tolist() for x in resample.features(words, orders, 997))):
            seen[t].append(b)
    for t, text in enumerate(texts):
        words = WORD.findall((text or b"").lower())
        want = [zlib.crc32(b" ".join(words[i : i + k])) % 997 for k in range(1, orders + 1) for i in range(len(words) - k + 1)]
        assert sorted(seen[t]) == sorted(want) and n[t] == len(words)


def test_words_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(Words, "hashes", lambda self: (np.zeros(len(self), np.uint64),) * 2)
    (words,) = slices([b"ab cd ab abcdefghij abcdefghik abcdefghij " + b"q" * 99])
    numbers, n = words.numbers()
    assert n == len(set(numbers.tolist())) == 5 and numbers[0] == numbers[2] and numbers[3] == numbers[5]


def test_same_draw_whatever_the_partitions(spark):
    docs = spark.createDataFrame(rows_of(), "doc_id long, text string")
    bench = spark.createDataFrame([("alpha",)], "text string")
    runs = [sorted(map(tuple, resample.resample(docs.repartition(n), bench).collect()), key=str) for n in (1, 9)]
    assert runs[0] == runs[1]
