import math
import random
import re
from collections import Counter

import pytest

from seqspark.llm import bloom_search as bs

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, items):
    bags = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        terms = set(TERM.findall((text or "").translate(FOLD)))
        found = []
        for i, b, size in bags:
            m = 100 - 90 + (90 * size * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms if t in b)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=str)


def tables():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)] + ["Ünï", "x9"]
    text = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    docs = [(k, text(rng.choice([1, 5, 40, 300]))) for k in range(500)]
    docs += [(900 + k, docs[7][1]) for k in range(60)] + [(7, docs[7][1]), (None, docs[7][1]), (None, docs[9][1]), (1001, None), (1002, ""), (1003, "-- !"), (1004, text(60_000)), (1005, "w3 " * 5000 + "W3,w4")]
    items = [(k, text(12) + "?") for k in range(25)] + [(30, docs[7][1]), (31, None), (32, "unseen words only"), (33, "w3 w3 W3"), (33, "w5"), (0, "w399 w398"), (34, docs[9][1]), (34, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1 << 24, 3000])
def test_against_brute_force(spark, shard_bytes):
    docs, items = tables()
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item int").repartition(5)
    it = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in bs.search(df, it, shard_bytes).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for d, i in ((docs, items), (some, items), (docs, some.withColumnRenamed("doc_id", "item_id")), (some.selectExpr("doc_id", "cast(null as string) as text"), some.withColumnRenamed("doc_id", "item_id"))):
        assert bs.search(d, i).collect() == []


def test_bounds_are_never_below_scores_and_exclude_most():
    import pyarrow as pa

    docs, items = tables()
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(i, k, (t or "").encode()) for k, (i, t) in enumerate(docs)]), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "key", "text"])
    rows = [r for b in bs._index([batch]) for r in b.to_pylist()]
    blocks = [r for r in rows if r["h"] is None]
    n, length = sum(len(r["keys"]) for r in blocks), sum(sum(r["sizes"]) for r in blocks)
    by_hash = Counter()
    for r in rows:
        if r["h"] is not None:
            by_hash[r["h"], r["g"]] += r["df"]
    df = Counter(t for _, text in docs for t in bs.term_counts((text or "").encode()))
    assert sorted(by_hash.values()) == sorted(df.values())
    queries = bs.Queries({k: {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in sorted(bs.term_counts((text or "").encode())) if t in df} for k, (_, text) in enumerate(items)})
    seen, close = 0, 0
    for r in blocks:
        block = bs._Read(r, n, length)
        for (own, a), sums in queries.bounds(block):
            for p, item in enumerate(own.tolist()):
                for d in range(sums.shape[1]):
                    exact = dict(queries.scores(bs.term_counts((docs[block.keys[a + d]][1] or "").encode()), [item], n, length)).get(item, 0)
                    assert sums[p, d] >= exact
                    seen, close = seen + 1, close + (sums[p, d] <= 1.1 * exact + 1)
    assert seen > 5000 and close > 0.5 * seen


def test_small_blocks_and_chunks(spark, monkeypatch):
    docs, items = tables()
    monkeypatch.setattr(bs, "CELLS", 64)
    rows = {}
    import pyarrow as pa

    monkeypatch.setattr(bs, "BLOCK_ROWS", 11)
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*[(i, k, (t or "").encode()) for k, (i, t) in enumerate(docs[:100])]), (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "key", "text"])
    blocks = [r for b in bs._index([batch]) for r in b.to_pylist() if r["h"] is None]
    assert max(len(r["keys"]) for r in blocks) == 11
    queries = bs.Queries({k: dict.fromkeys(bs.term_counts((t or "").encode()), 100 + k) for k, (_, t) in enumerate(items[:10])})
    for r in blocks:
        block = bs._Read(r, 100, 5000)
        for (own, a), sums in queries.bounds(block):
            for p, item in enumerate(own.tolist()):
                for d in range(sums.shape[1]):
                    rows[item, int(block.keys[a + d])] = int(sums[p, d])
    monkeypatch.setattr(bs, "CELLS", 1 << 21)
    for r in blocks:
        block = bs._Read(r, 100, 5000)
        for (own, a), sums in queries.bounds(block):
            for p, item in enumerate(own.tolist()):
                for d in range(sums.shape[1]):
                    assert rows.pop((item, int(block.keys[a + d]))) == sums[p, d]
    assert not rows or not any(rows.values())
