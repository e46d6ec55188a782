import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqspark.llm import shards
from seqspark.llm.common import cut, numbered


def plain_differencing(sizes, ways):
    """The procedure with lists of items in place of back-pointers."""
    parts = [([([i], s)] + [([], 0)] * (ways - 1)) for i, s in enumerate(sizes)]
    spread = lambda p: p[0][1] - (p[-1][1] if ways > 1 else 0)
    order = list(range(len(parts)))
    live, new = dict(zip(order, parts)), len(parts)
    while len(live) > 1:
        a, b = sorted(live, key=lambda k: (-spread(live[k]), k))[:2]
        x, y = live.pop(a), live.pop(b)
        live[new] = sorted(((p[0] + q[0], p[1] + q[1]) for p, q in zip(x, reversed(y))), key=lambda t: -t[1])
        new += 1
    (last,) = live.values()
    return {i: k for k, (items, _) in enumerate(last) for i in items}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=30), st.integers(1, 6))
def test_differencing_is_the_plain_procedure(sizes, ways):
    got = shards.differencing(np.array(sizes), ways)
    assert dict(enumerate(got.tolist())) == plain_differencing(sizes, ways)


def test_differencing_beats_greedy_filling():
    rng = random.Random(3)
    sizes = sorted((rng.randint(1, 10**6) for _ in range(3000)), reverse=True)
    sums = np.bincount(shards.differencing(np.array(sizes), 7), sizes, minlength=7)
    greedy = [0] * 7
    for s in sizes:
        greedy[greedy.index(min(greedy))] += s
    assert sums.max() - sums.min() < max(greedy) - min(greedy)


def sums_of(rows, ways):
    sums = [0] * ways
    for r in rows:
        sums[r["shard"]] += r["size"]
    return sums


@pytest.mark.parametrize(("bucket", "fan", "fine"), [(50_000, 250, 20_000), (40, 50, 100), (7, 3, 100), (7, 3, 0)])
def test_trees_of_steps_balance_and_lose_no_group(spark, bucket, fan, fine):
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 500)) for k in range(900)] + [(-1, 9000), (-2, 1)]
    groups = cut(spark.createDataFrame(rows, "key long, size long"))
    got = {r["key"]: r["shard"] for r in shards.assign(groups, 8, bucket, fan, fine).collect()}
    assert got.keys() == dict(rows).keys()
    sums = np.bincount(list(got.values()), [dict(rows)[k] for k in got], minlength=8)
    assert sums.max() - sums.min() <= (40 if fine else 5000)


def test_one_group_above_its_share(spark):
    rows = [(k, 100 + k % 7) for k in range(500)] + [(1000, 40_000)]
    got = {r["key"]: r["shard"] for r in shards.assign(cut(spark.createDataFrame(rows, "key long, size long")), 4, 30, 5, 60).collect()}
    sums = np.bincount(list(got.values()), [dict(rows)[k] for k in got], minlength=4)
    assert sorted(sums.tolist())[-1] == 40_000 and sorted(sums.tolist())[2] - sorted(sums.tolist())[0] < 100


def test_documents(spark):
    rng = random.Random(2)
    texts = [f"text {k} " * rng.randint(1, 60) for k in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, texts[3]) for k in range(150)] + [(5, texts[5]), (None, "é" * 90), (None, None), (None, ""), (2000, None), (2001, "z" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, shard int, row string").repartition(5)
    got = shards.shards(df, 6).collect()
    data = lambda t: (t or "").encode()
    want = sorted(((i, len(data(t)) + 16, zlib.crc32(data(t))) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    by_text = {}
    for r in got:
        by_text.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(x) == 1 for x in by_text.values())
    for s in range(6):
        own = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own)
    sums = sorted(sums_of(got, 6))
    assert sums[-1] == 300_016 and sums[4] - sums[0] < 200
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    again = shards.shards(df.repartition(2), 6).collect()
    assert sums_of(again, 6) == sums_of(got, 6)


def test_few_and_no_documents(spark):
    schema = "doc_id long, text string"
    assert shards.shards(spark.createDataFrame([], schema)).collect() == []
    got = shards.shards(spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a")], schema)).collect()
    assert len({r["shard"] for r in got}) == 2 and sorted(r["slot"] for r in got) == [0, 0, 1]


def test_numbered_splits_equal_keys(spark):
    rows = cut(spark.range(1000).selectExpr("id as row", "cast(id % 2 as int) as g", "1 as k").repartition(7))
    got = numbered(rows, ["k", "row"], "g").collect()
    for g in (0, 1):
        own = sorted((r["row"], r["place"]) for r in got if r["g"] == g)
        assert [p for _, p in own] == list(range(500))
    assert sorted(r["place"] for r in numbered(rows, ["k", "row"]).collect()) == list(range(1000))
