"""Near copies meet by their SimHash fingerprints; a tile writes trees, not pairs."""

import numpy as np
import pyarrow as pa
import pytest

from seqspark.llm import near_copies as nc


@pytest.mark.parametrize(("n", "other"), [(5, 0), (20, 2), (45, 5), (100, 11)])
def test_near_copies_at_the_limit_meet(n, other):
    random = np.random.default_rng(n)
    draw = lambda k: random.integers(0, 1 << 63, k, dtype=np.uint64)
    for _ in range(100):
        both = draw(n - max(other, 1))
        a, b = np.unique(np.concatenate([both, draw(max(other, 1))])), np.unique(np.concatenate([both, draw(other)]))
        assert nc.jaccard(a, b) >= nc.SIMILAR
        (x, x_margin), (y, y_margin) = nc.fingerprint(a), nc.fingerprint(b)
        assert (x != y).sum() <= nc.radius(len(a), len(b))
        fp, weak = np.packbits(np.array([x, y]), axis=1, bitorder="little"), np.array([nc.weakest(m, 12, 14).ravel() for m in (x_margin, y_margin)])
        one, two = nc.buckets_of(fp, weak, 12, 14).tolist()
        assert n > nc.SHORT and set(one) & set(two) or set(nc.least_of(a).tolist()) & set(nc.least_of(b).tolist())


def test_a_tile_of_alike_texts_gives_a_tree():
    texts = [f"{k} " + " ".join(f"w{i}" for i in range(100)) for k in range(60)]
    rows = [{"key": k, "near": False, "text": t.encode()} for k, t in enumerate(texts)]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("near", pa.bool_()), ("text", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([rows[:40], rows[:30]], kind), pa.array([[], rows[30:]], kind)], names=["left", "right"])
    one, two = nc._verify([batch])
    assert len(one) == 39 and len(two) == 59  # one tile; two tiles, whose pairs across join all
