"""Every pair of near copies meets, whatever its fingerprints' bits."""

import numpy as np
import pyarrow as pa
import pytest

from seqspark.llm import near_copies as nc


def test_near_copies_without_a_block_of_bits_in_common_are_linked(spark):
    """Pairs at Jaccard 0.8 whose fingerprints agree in no block, not even with their least certain bits changed."""
    rows = []
    for i, seed in enumerate((229072, 504960, 634848, 706512, 138153, 170537)):
        words = [f"w{seed}x{k}" for k in range(49)]
        pair = " ".join(words), " ".join([*words[:24], "changed", *words[25:]])
        sets = [nc.shingle_set(t.encode()) for t in pair]
        assert nc.jaccard(*sets) == 0.8
        (x, a), (y, b) = map(nc.fingerprint, sets)
        one, two = nc.buckets_of(np.packbits([x, y], axis=1, bitorder="little"), np.array([nc.weakest(m, 12, 14).ravel() for m in (a, b)]), 12, 14).tolist()
        assert not set(one) & set(two)
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
    got = nc.near_copies(spark.createDataFrame(rows, "key long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(k, k - k % 2) for k in range(len(rows))]


@pytest.mark.parametrize("n", [1, 4, 9, 45, 1000])
def test_beginnings_of_near_copies_share_a_shingle_in_any_order(n):
    random = np.random.default_rng(n)
    for share in (0.0, 0.3, 1.0):
        both = random.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = n // 4
        a, b = (np.unique(np.concatenate([both, random.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (extra // 2, extra - extra // 2))
        assert nc.jaccard(a, b) >= nc.SIMILAR
        known = np.unique(random.choice(both, int(share * n), replace=False))
        common = known, random.permutation(len(known))
        assert set(nc.least_of(a, common).tolist()) & set(nc.least_of(b, common).tolist())


def test_buckets_in_batches_of_any_size():
    """Links of small and middling buckets, rows of those above the tile, wherever batches end."""
    random = np.random.default_rng(5)
    alike = random.integers(0, 256, 32, dtype=np.uint8).tobytes()
    rows, want, large = [], set(), []
    for bucket, size in enumerate((1, 2, 3, 12, 1, 40, 7, 33, 5)):
        keys = [100 * bucket + k for k in range(size)]
        rows += [(bucket, k, 50, alike if k % 2 else random.integers(0, 256, 32, dtype=np.uint8).tobytes()) for k in keys]
        odd = [k for k in keys if k % 2]
        if size > 32:
            large += keys
        elif len(odd) > 1:
            want.add(tuple(odd))
    whole = pa.RecordBatch.from_pylist([dict(zip(("bucket", "key", "n", "fp"), r, strict=True)) for r in rows], pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("fp", pa.binary())]))
    for step in (1, 5, 17, len(rows)):
        out = [r for b in nc._meet(32)(whole.slice(at, step) for at in range(0, len(rows), step)) for r in b.to_pylist()]
        assert sorted(r["key"] for r in out if r["other"] is None) == large
        root = {k: k for k in range(1000)}
        for r in out:
            if r["other"] is not None:
                a, b = root[r["key"]], root[r["other"]]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        groups = {}
        for k, v in root.items():
            groups.setdefault(v, []).append(k)
        assert {tuple(g) for g in groups.values() if len(g) > 1} == want
