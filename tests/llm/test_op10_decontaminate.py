import pickle
import random
import time

from seqspark.llm import decontaminate as dc


def test_finds_exactly_the_planted_items(spark):
    random.seed(3)
    lexicon = [f"w{i}" for i in range(400)]
    prose = lambda n: random.choices(lexicon, weights=[1 / (k + 1) for k in range(400)], k=n)
    items = {i: prose(random.randint(12, 60)) for i in range(60)}
    docs, want = [], set()
    for i in range(120):
        words = prose(random.randint(0, 400))
        if i % 4 == 0:
            k = i // 4
            at = random.randint(0, len(words))
            leak = list(items[k])
            if i % 8 == 0 and len(leak) > 40:
                leak[7] = "changed"  # 5 of 37 shingles or more
            words[at:at] = [w.upper() + "," for w in leak]
            want.add((i, k))
        docs.append((i, " ".join(words), 0))
    docs += [(900, None, 0), (901, "", 0), (902, "w1", 0), (903, " ".join(prose(30000) + items[59]), 0), (4, docs[4][1], 0)]
    want.add((903, 59))
    bench = [(i, " ".join(w), "x") for i, w in items.items()] + [(5, " ".join(items[5]), "x"), (990, None, "x"), (991, "", "x"), (992, "zzz qqq", "x")]
    df, tests = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(bench, "item_id long, text string, term string")
    # Brute force: items of which 4 in 5 word shingles of question and answer stand in the document.
    brute = set()
    for i, t, _ in docs:
        own = dc.shingles(dc.words_of((t or "").encode()))
        for k, w in items.items():
            q, a = dc._question_answer(" ".join(w).encode(), None)
            parts = [dc.shingles(x) for x in (q, a) if x]
            whole = dc.shingles([x.encode() for x in w])
            if all(len(p & own) >= 0.8 * len(p) for p in parts) or len(whole & own) >= 0.8 * len(whole):
                brute.add((i, k))
    for shard in (dc.SHARD_BYTES, 3000):
        got = [(r["doc_id"], r["item_id"]) for r in dc.leaks(df, tests, shard).collect()]
        assert set(got) == brute >= want and len(got) == len(brute) + 1  # document 4 twice


def test_question_and_answer_columns(spark):
    tests = spark.createDataFrame([(1, "what is the colour of the sky above us", "it is blue on most days")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "What is the colour of the sky above us? It is blue on most days!"), (2, "what is the colour of the sky above us")], "doc_id long, text string")
    assert [r["doc_id"] for r in dc.leaks(docs, tests).collect()] == [1]


def test_empty_tables(spark):
    docs, tests = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert dc.leaks(docs.where("false"), tests).collect() == [] and dc.leaks(docs, tests.where("false")).collect() == []
    assert [r["item_id"] for r in dc.leaks(docs, tests).collect()] == [1]


def test_edited_items_are_found_by_their_whole_overlap(spark):
    random.seed(9)
    lexicon = [f"w{i}" for i in range(400)]
    items = {k: random.choices(lexicon, k=random.randint(30, 60)) for k in range(8)}
    docs, want, halves = [], set(), set()
    for k, words in items.items():
        for at in range(len(words)):
            edited = [*words[:at], "changed", *words[at + 1 :]]
            i = 100 * k + at
            docs.append((i, " ".join(random.choices(lexicon, k=40) + edited + random.choices(lexicon, k=40))))
            own, whole = dc.shingles(edited), dc.shingles(words)
            if len(whole & own) >= 0.8 * len(whole):
                want.add((i, k))
            if all(len(p & own) >= 0.8 * len(p) for p in map(dc.shingles, dc._question_answer(" ".join(words).encode(), None))):
                halves.add((i, k))
    tests = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), tests).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | halves and len(want - halves) > 50
    assert all(r["item_overlap"] >= 0.8 for r in got if (r["doc_id"], r["item_id"]) in want)


def test_other_items_do_not_change_a_verdict(spark):
    """A long item beside it, or many, leave an item's leaks as they are."""
    random.seed(4)
    lexicon = [f"w{i}" for i in range(900)]
    item = random.choices(lexicon, k=30)
    docs = [(k, " ".join(random.choices(lexicon, k=150) + item[: 30 - k] + random.choices(lexicon, k=90))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    alone = [(1, " ".join(item))]
    others = [(9, " ".join(random.choices(lexicon, k=400))), *((20 + k, " ".join(random.choices(lexicon, k=20))) for k in range(40))]
    found = [sorted(r["doc_id"] for r in dc.leaks(df, spark.createDataFrame(x, "item_id long, text string")).where("item_id = 1").collect()) for x in (alone, alone + others)]
    assert found[0] == found[1] == [k for k in range(12) if 30 - k - 4 >= 0.8 * 26]


def test_retrieval_equals_scoring_every_item():
    """Pivot and block maxima lose no (passage, item) that plain sums bring to the threshold, and find no other."""
    random.seed(5)
    lexicon = [b"w%d" % i for i in range(60)]
    items = [(k, random.choices(lexicon, weights=[1 / (j + 1) for j in range(60)], k=random.randint(5, 70)), [], True) for k in range(50)]
    df = {w: sum(w in q for _, q, _, _ in items) for w in lexicon}
    index = dc.Index(items, df, 50, 30.0)
    texts = [b" ".join(random.choices([*lexicon, b"other"], k=random.randint(0, 700))) for _ in range(30)] + [b" ".join(q) for _, q, _, _ in items]
    words, begin = index.numbers_of(texts)
    assert len(index.classes) == 2
    for own in index.classes:
        first, passage, term = own.passages(words, begin)
        got = {(int(p), int(k)): s for p, k, s in zip(*own.retrieve(passage, term), strict=True)}
        want = {}
        for t in range(len(texts)):
            part = words[begin[t] : begin[t + 1]].tolist()
            for j in range(first[t + 1] - first[t]):
                some = set(part[j * own.step : (j + 2) * own.step])
                for k in range(len(own.ids)):
                    at = [x for x in range(len(own.items)) if own.items[x] == k and any(own.starts[w] <= x < own.starts[w + 1] for w in some if w >= 0)]
                    score = sum(own.values[at])
                    if score >= 1 - dc.ROUNDING:
                        want[int(first[t]) + j, k] = score
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want) and len(want) >= len(own.ids)


def test_index_is_flat():
    """What is broadcast stays a small multiple of the items' text, also where few words repeat; shingles kept do not travel."""
    random.seed(7)
    for n_words, most in ((3_000, 5), (60_000, 10)):
        lexicon = [b"word%d" % i for i in range(n_words)]
        items = [(k, random.choices(lexicon, k=60), [], True) for k in range(3000)]
        df = {}
        for _, q, _, _ in items:
            for w in set(q):
                df[w] = df.get(w, 0) + 1
        index = dc.Index(items, df, len(items), 60.0)
        size = len(pickle.dumps(index))
        assert size < most * sum(len(b" ".join(q)) for _, q, _, _ in items)
        assert [x[:2] for x in index.search([b" ".join(items[7][1])])] == [(0, 7)] and sum(len(c.kept) for c in index.classes) == 1
    # More items than are kept at once.
    texts = [b" ".join(q) for _, q, _, _ in items]
    kept, dc.KEPT = dc.KEPT, 10
    try:
        assert sorted(x[:2] for x in index.search(texts)) == [(k, k) for k in range(3000)] and all(len(c.kept) <= 10 for c in index.classes)
    finally:
        dc.KEPT = kept


def test_long_text_and_many_items():
    random.seed(6)
    lexicon = [b"word%d" % i for i in range(30_000)]
    items = [(k, random.choices(lexicon, k=40), [], True) for k in range(20_000)]
    df = {}
    for _, q, _, _ in items:
        for w in set(q):
            df[w] = df.get(w, 0) + 1
    index = dc.Index(items, df, len(items), 40.0)
    text = b" ".join(random.choices(lexicon, k=165_000) + items[7][1] + random.choices(lexicon, k=500))
    began = time.time()
    assert [x[:2] for x in index.search([text])] == [(0, 7)] and time.time() - began < 5
