import math

import numpy as np
import pytest

from seqspark.llm import embed_caps


def brute(rows, cosine=0.9):
    good = {k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label, links = {k: rows[k][0] for k in good}, dict.fromkeys(good, 0)
    unit = {k: np.array(rows[k][1], np.float32).astype(float) for k in good}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = {k: [j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in good}
    links = {k: len(v) for k, v in near.items()}
    for _ in good:
        label = {k: min([label[k], *(label[j] for j in near[k])]) for k in good}
    return sorted([(i, links.get(k, 0), label.get(k, i), i is not None and label.get(k, i) == i) for k, (i, _) in enumerate(rows)], key=str)


def test_against_brute_force_with_small_tiles(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    vectors = [b + rng.normal(size=24) * s for b in base[:20] for s in (0, 0.05, 0.1, 0.3)] + [base[0] + rng.normal(size=24) * 0.02 for _ in range(30)]
    rows = [(i * 2, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    rows += [(1001, rows[5][1]), (1003, rows[5][1]), (1003, rows[5][1]), (1005, None), (1007, [0.0] * 24), (1009, [1.0, None]), (1011, [math.nan] * 24), (1013, [math.inf, 1.0]), (1015, []), (None, rows[0][1]), (1017, [1.0, 2.0]), (1019, [-0.0, 0.0, 3.0]), (1021, [0.0, -0.0, 3.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, filter int")
    want = brute(rows)
    for tile in (8, 1024):  # a low share makes decoding complete
        assert sorted(map(tuple, embed_caps.near_duplicates(df, share=0.8, tile=tile).collect()), key=str) == want


def test_links_at_the_default_share(spark):
    """No wrong link, and at least 0.97 of the right ones, most of them close to the threshold."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = [b + rng.normal(size=32) * 0.058 for b in base for _ in range(12)]
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)]
    want = {r[0]: r[1] for r in brute(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embed_caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.97 * sum(want.values()) > 1000


@pytest.mark.parametrize("centres", [16, 24, 32, 64])
def test_recall_at_the_threshold(centres):
    rng = np.random.default_rng(4)
    x, r = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r -= (r * x).sum(1, keepdims=True) * x
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    code = embed_caps.Code(64, centres=centres)
    both = [len(np.intersect1d(a, b)) > 0 for a, b in zip(code.decode(x), code.decode(0.9 * x + math.sqrt(0.19) * r), strict=True)]
    assert np.mean(both) > 0.97


def test_centres_grow_with_the_vectors():
    assert [embed_caps.centres_for(n) for n in (0, 10**6, 10**7, 10**9)] == [16, 16, 32, 80]


def test_empty_table(spark):
    assert embed_caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
