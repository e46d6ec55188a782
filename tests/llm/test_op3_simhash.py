import random
import re

import numpy as np
import xxhash

from seqspark.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = {i: i for i, f in fps}
    changed = True
    while changed:
        changed = False
        for i, f in fps:
            for j, g in fps:
                if (f ^ g).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint(monkeypatch):
    for text in [None, "", " \n\t", "One", "one TWO", "Éa b c d e f g h i\x1cj k l m", "the the the the the", "a b c " * 4000]:
        assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


def test_close_pairs_against_brute_force():
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(60)]
    fps = np.array([b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base for _ in range(20)] + base, np.uint64)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 2}
    i, j = simhash.close_pairs(fps, None, tile=32)
    assert {(min(p), max(p)) for p in zip(i.tolist(), j.tolist())} == want
    a, b = simhash.close_pairs(fps[:300], fps[300:], tile=32)
    assert {(x, y + 300) for x, y in zip(a.tolist(), b.tolist())} == {(x, y) for x, y in want if x < 300 <= y}


def test_links_with_small_tiles_equal_brute_force(spark):
    random.seed(6)
    base = [random.getrandbits(63) for _ in range(20)]
    fps = sorted({b ^ (1 << random.randrange(20)) ^ (1 << random.randrange(40)) for b in base for _ in range(15)})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}
    for tile in (4, 4096):
        assert {(min(r), max(r)) for r in simhash.links(reps, tile).collect()} == want


def test_near_duplicates(spark):
    random.seed(7)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(12)]
    texts += [t + " extra" for t in texts[:6]] + texts[:3] + [None, "", " ", "one", "two words"]
    rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)] + [(1, texts[0], "x"), (None, texts[0], "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    label = brute_components([(i, brute_fingerprint(t)) for i, t, _ in rows if i is not None])
    assert {
        (r["doc_id"], r["fingerprint"], r["component_id"]) for r in got
    } == {(i, f"{brute_fingerprint(t):016x}", label[1 if i is None else i]) for i, t, _ in rows}
    assert len(got) == len(rows)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
