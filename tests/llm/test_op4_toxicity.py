import random

import pytest

from seqspark.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(8)
    calm = [f"{a}{b}" for a in ("lor", "mip", "sun", "dol") for b in ("em", "ax", "ot", "in", "ea")]
    rude = ["idiot", "zarkwad", "zarkling", "zarkish", "moron"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = random.choices(calm, k=random.randint(5, 60))
        for _ in range(random.randint(1, 3) if toxic else 0):
            words.insert(random.randrange(len(words)), random.choice(rude) + random.choice(["", ",", "!"]))
        docs.append((i, " ".join(words), "x"))
        if i % 3 != 1:
            labels.append((i, 0, int(toxic)))
    docs += [(601, None, "x"), (602, "", "x"), (None, "lorem idiot", "x"), (603, "sunea " * 20000 + "YOU zarkwad!", "x"), (0, docs[0][1], "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, features string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark, tables):
    docs, labels = tables
    got = toxicity.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    own = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    right = [r["predicted"] == int(r["doc_id"] % 6 == 0) for r in own]
    assert len(own) > 80 and sum(right) / len(right) > 0.95
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[601] == by[602] == 0


def test_held_out_labels_are_not_read(spark, tables):
    import zlib

    docs, labels = tables
    kept = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    flipped = [(r["doc_id"], 0, 1 - r["toxic"]) if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 else tuple(r) for r in labels.collect()]
    assert len(kept) < len(flipped)
    rows = toxicity.training_rows(docs, spark.createDataFrame(flipped, labels.schema)).select("doc_id", "toxic").collect()
    assert sorted(map(tuple, rows)) == sorted((r["doc_id"], r["toxic"]) for r in kept)


def test_nothing_to_learn_from(spark, tables):
    docs, labels = tables
    assert {r["score"] for r in toxicity.report(docs, labels.where("false")).collect()} == {0.0}
    assert toxicity.report(docs.where("false"), labels).collect() == []


def test_features_of_pieces_and_near_persons():
    words = toxicity.Words({"idiot": 2.0, "zark*": 1.0})
    named = dict(zip(toxicity.FEATURES, toxicity.features(b"You IDIOT! a b c d e f g h zarkling 1d1ot", words), strict=True))
    assert (named["word_hits"], named["stem_hits"], named["disguised_hits"], named["hits_near_person"]) == (1, 1, 1, 1)
    assert len(toxicity.features(None, words)) == len(toxicity.FEATURES)


def test_every_run_of_letters_counts():
    words = toxicity.Words({"idiot": 2.0, "zark*": 1.0})
    for text, hits, stems in ((b"a,b,c,idiot", 1, 0), (b"a,b,c,d,e,f,g,h,idiot", 1, 0), (b"idiot/idiot.zarkwad" + b",x" * 5000 + b",idiot", 3, 1)):
        named = dict(zip(toxicity.FEATURES, toxicity.features(text, words), strict=True))
        assert (named["word_hits"], named["stem_hits"]) == (hits, stems)


def test_lexicon_covers_all_labelled_rows_and_long_words(spark):
    long = "q" * 60
    rows = [(f"calm words {long if k < 6 else ''}", 1) for k in range(40)] + [("calm words only", 0)] * 200
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert long in lexicon and "calm" not in lexicon


def test_texts_that_share_an_id_are_all_learned_from(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "two"), (1, "two"), (2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert sorted(r["text"] for r in rows) in (["one", "two"], [])  # id 1 may be held out
    assert len(rows) == 2


def test_partitions_without_rows_and_flush_on_the_last_row(spark, monkeypatch):
    rows = [(k, f"calm words {'zarkwad' if k < 6 else 'only'} {k}", "x") for k in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, 0, int(k < 6)) for k in range(1, 12)], "doc_id long, quality int, toxic int")
    for parts in (8, 24):
        got = toxicity.report(docs.repartition(parts, "doc_id"), labels).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(1, 12))
    import pandas as pd

    monkeypatch.setattr(toxicity, "ENTRIES_KEPT", 1)
    frames = list(toxicity._entry_counts([pd.DataFrame({"text": ["one two", None, "two"], "toxic": [1, 0, 0]}), pd.DataFrame({"text": [], "toxic": []})]))
    sums = pd.concat(frames).groupby("entry").sum()
    assert sums.loc["two"].tolist() == [1, 1] and sums.loc["one"].tolist() == [0, 1] and all(len(f) for f in frames)
    assert list(toxicity._entry_counts([])) == []


def test_a_lexicon_too_large_to_send_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEXICON_BYTES", 100)
    rows = [("zarkwad calm", 1)] * 9 + [("calm", 0)] * 99
    with pytest.raises(ValueError, match="min_share"):
        toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))


def test_score_matches_trees_and_isotonic_steps_worked_out_by_hand(spark, tables):
    """The score of every row is recomputed in Python from the fitted trees' splits and the isotonic table."""
    import bisect
    import math
    import re

    docs, labels = tables
    model = toxicity.Model(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.with_features(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), model.lexicon).collect()}

    def leaf(lines, x, depth=0):
        """Walks the printed form of a tree: If/Else lines indented by depth, then Predict."""
        at = 0
        while True:
            line = lines[at].strip()
            if line.startswith("Predict"):
                return float(line.split(":")[1])
            k, sign, bound = re.match(r"If \(feature (\d+) (<=|>) ([-\d.E]+)\)", line).groups()
            if (x[int(k)] <= float(bound)) == (sign == "<="):
                at += 1
                continue
            indent = len(lines[at]) - len(lines[at].lstrip())
            at = next(i for i in range(at + 1, len(lines)) if lines[i].strip().startswith("Else") and len(lines[i]) - len(lines[i].lstrip()) == indent) + 1

    trees = [t.toDebugString.split("\n")[1:] for t in model.trees.trees]
    edges, values = model.calibration.boundaries.toArray().tolist(), model.calibration.predictions.toArray().tolist()

    def by_hand(x):
        total = sum(w * leaf(t, x) for w, t in zip(model.trees.treeWeights, trees, strict=True))
        raw = 1 / (1 + math.exp(-2 * total))
        k = bisect.bisect_left(edges, raw)
        if k < len(edges) and edges[k] == raw or k in (0, len(edges)):
            step = values[min(k, len(edges) - 1)]
        else:
            step = values[k - 1] + (values[k] - values[k - 1]) * (raw - edges[k - 1]) / (edges[k] - edges[k - 1])
        return 0.999 * step + 0.001 * raw

    got = {r["doc_id"]: r["score"] for r in model.score(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(rows) > 600
    for i, r in rows.items():
        assert got[i] == pytest.approx(by_hand(r["features"]), abs=1e-9)
