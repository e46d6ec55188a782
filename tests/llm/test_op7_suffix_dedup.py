import hashlib
import random

import numpy as np
import pytest

from seqspark.llm import suffix_dedup as sd


def brute(rows, n=50):
    least = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = lambda i: sd.LAST if i is None else i
    for i, t in texts:
        for p in range(len(t) - n + 1):
            least[t[p : p + n]] = min(least.get(t[p : p + n], sd.LAST), order(i))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if least[t[p : p + n]] < order(i):
                gone[p : p + n] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def many_rows():
    random.seed(9)
    word = lambda: "".join(random.choices("abcdé", k=random.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, short = prose(60), prose(30)[:50]
    rows = [(3, prose(90) + passage + prose(40)), (1, passage[5:] + prose(100)), (9, prose(20) + passage[:-9] + prose(5) + passage), (5, passage), (6, passage), (2, short), (4, "x" + short[:-1]), (7, prose(10) + short + "é"), (8, None), (10, ""), (11, "a" * 700), (12, "b" + "a" * 500), (13, "ab" * 80), (14, "ba" * 70), (6, passage + "tail"), (6, passage), (None, passage + "zz"), (None, prose(200)), (15, prose(300)), (16, prose(3) + "line of forty-nine bytes that is repeated here!!"), (17, "line of forty-nine bytes that is repeated here!!\n" * 5), (18, "c" + "a" * 420 + "d" + "a" * 60)]
    rows += [(20 + k, " ".join(passage.split()[:k] + [word()] + passage.split()[k:])) for k in range(0, 60, 3)]
    common = "exactly twenty-four byte"
    return rows + [(60 + k, prose(8) + common + prose(random.randint(0, 9))) for k in range(40)] + [(100 + k, prose(9) + common * 2 + prose(3)) for k in range(9)]


@pytest.mark.parametrize("how", [{}, {"id_bits": 3}, {"hot": 2}, {"hot": 2, "id_bits": 5}])
def test_against_brute_force(spark, how):
    """Whole results, also where unequal strings are made to meet and where every shared anchor counts as hot."""
    rows = many_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(5)
    assert sorted(map(tuple, sd.dedup(df, **how).drop("kept").collect()), key=str) == brute(rows)


def test_kept_text(spark):
    passage = "a passage of more than fifty bytes, the second time it goes!"
    rows = sd.dedup(spark.createDataFrame([(1, passage), (2, "x" + passage + "y")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows} == {1: passage.encode(), 2: b"xy"}


def test_steps_do_not_change_anchors(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (10, 49, 50, 51, 700, 0, 90)] + [b"a" * 300]
    data, begin = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def places():
        return {p for place, run, _ in zip(*sd.anchors(data, begin, np.uint64(2**64 - 1)), strict=True) for p in range(place, place + run)}

    whole = places()
    assert all(any(p <= s + 26 and p >= s for p in whole) for a, b in zip(begin[:-1], begin[1:], strict=True) for s in range(a, b - 49))
    monkeypatch.setattr(sd, "STEP", 64)
    assert places() == whole


def test_refinement_against_comparison():
    rng = np.random.default_rng(3)
    around = np.zeros((60, sd.WIDTH), np.uint8)
    around[:, : sd.AROUND] = rng.integers(97, 99, sd.AROUND, dtype=np.uint8)
    for row in around[10:]:
        row[rng.integers(0, sd.AROUND, 2)] = 120
    around[:, sd.AROUND], around[:, sd.AROUND + 1] = rng.integers(10, 27, 60), rng.integers(40, 51, 60)
    doc = rng.integers(0, 40, 60)
    want = set()
    for k in range(27):
        at = [i for i in range(60) if k <= around[i, 76] and 50 - k <= around[i, 77]]
        text = {i: around[i, 26 - k : 76 - k].tobytes() for i in at}
        want |= {(i, k) for i in at if any(text[j] == text[i] and doc[j] < doc[i] for j in at)}
    assert {(i, k) for item, k in sd.repeated_windows(around, doc) for i in item.tolist()} == want and want


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
