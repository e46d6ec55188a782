import random

import pytest

import corpus_pipeline
from seqspark.llm import near_copies, simhash


def test_two_texts_under_one_id_are_two_documents(spark):
    random.seed(4)
    lexicon = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "en", "il", "oro", "us")]
    one, two, three = (" ".join(random.choices(lexicon, k=60)) for _ in range(3))
    four = " ".join(random.choices(lexicon, k=60))
    # Document 7 has a text of its own and a copy of document 3's; the copy goes, its other text stays.
    rows = [(7, one), (7, two), (3, two), (3, two), (9, three), (None, three), (None, one + " " + three), (5, four), (5, four + " " + one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(7, one), (3, two), (9, three), (None, one + " " + three), (5, four), (5, four + " " + one)], key=str)


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, "some words here", s, None) for s in ("b", "a", None, "c")] + [(2, "other text", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    for parts in (1, 4):
        got = corpus_pipeline.near_copies(spark, docs.repartition(parts), "").collect()
        assert sorted(map(tuple, got)) == [(1, "some words here", None, None), (2, "other text", "z", 1)]


@pytest.mark.parametrize("tile", [1024, 16])
def test_groups_are_those_of_brute_force_jaccard(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    random.seed(6)
    lexicon = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "en", "il", "oro", "us")]
    texts = [random.choices(lexicon, k=random.randint(80, 200)) for _ in range(25)]
    for k in range(25):
        for edits in (1, 2, 2, 3, 5):
            copy = list(texts[k])
            for at in random.sample(range(len(copy)), edits):
                copy[at] = random.choice(lexicon)
            texts.append(copy)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(200, ""), (201, None), (202, "ken bab"), (203, "Ken  bab"), (204, "bab ken"), (3, " ".join(texts[3]))]
    sets = {i: set(zip(*((w := (t or "").lower().split())[j:] for j in range(5)))) or {tuple(w)} for i, t in rows}
    near = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    far = [(i, j) for i, j in near if (fps[i] ^ fps[j]).bit_count() > 2]
    assert len(far) > 50  # not caught by two bits
    label = {i: i for i in sets}
    while (new := {i: min([label[i], *(label[a + b - i] for a, b in near if i in (a, b))]) for i in sets}) != label:
        label = new
    docs = spark.createDataFrame(rows, "key long, text string").repartition(4)
    got = near_copies.near_copies(docs).collect()
    assert sorted(map(tuple, got)) == sorted(label.items())
    kept = corpus_pipeline.near_copies(spark, docs.withColumnRenamed("key", "doc_id"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(label.values()))
    assert near_copies.near_copies(docs.where("false")).collect() == []


def test_a_bucket_of_alike_texts_that_are_no_near_copies(spark, monkeypatch):
    """Texts with a passage in common: many pairs in one bucket, compared in tiles; only true near copies link."""
    random.seed(9)
    lexicon = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ab", "en", "il", "oro", "us")]
    passage = random.choices(lexicon, k=120)
    texts = [passage + random.choices(lexicon, k=60) for _ in range(120)]
    texts += [t[:-1] + ["zz"] for t in texts[:5]]
    monkeypatch.setattr(near_copies, "TILE", 32)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "key long, text string").repartition(4)
    got = dict(map(tuple, near_copies.near_copies(docs).collect()))
    assert got == {i: i - 120 if i >= 120 else i for i in range(125)}
