import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from seqspark.llm import decontaminate, mixing, simhash, token_parquet, toxicity


def tables():
    random.seed(21)
    lexicon = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "tu") for b in ("ren", "sol", "vat", "kin") for c in ("", "a", "os", "is")]
    prose = lambda n: random.choices(lexicon, k=n)
    items = {k: prose(20) for k in range(8)}
    docs, labels = [], []
    for i in range(240):
        words = prose(random.randint(20, 80))
        toxic = i % 8 == 3
        if toxic:
            for _ in range(3):
                words.insert(random.randrange(len(words)), random.choice(["idiot", "moron", "scum"]))
        if i % 30 == 5:
            words[4:4] = items[i % 8]
        docs.append((i, " ".join(words), "en", ("a", "b", "c", None)[i % 4], 0))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[i][1], "en", "b", 0) for i in range(0, 40, 3)] + [(400, "", "en", "a", 0), (401, None, "en", None, 0), docs[7]]
    return docs, labels, [(k, " ".join(w)) for k, w in items.items()]


def test_run_against_stages_by_brute_force(spark, tmp_path):
    docs, labels, items = tables()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(docs, schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # Toxicity: the model's own verdicts; all planted ones go, none of the others.
    bad = {r["doc_id"] for r in toxicity.report(df, marks).collect() if r["predicted"]}
    assert bad >= {i for i, _, toxic in labels if toxic}
    rows = [r for r in docs if r[0] not in bad]
    # Near copies: fingerprints within two bits, linked until nothing changes; the smallest id stays.
    fps = {i: simhash.fingerprint((t or "").encode()) for i, t, *_ in rows}
    label = {i: i for i in fps}
    while (new := {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 2) for i in fps}) != label:
        label = new
    rows = list({r[0]: r for r in rows if label[r[0]] == r[0]}.values())
    # Leaks: items whose shingles stand in the document.
    own = {r[0]: decontaminate.shingles(decontaminate.words_of((r[1] or "").encode())) for r in rows}
    parts = [[decontaminate.shingles(x) for x in decontaminate._question_answer(t.encode(), None)] for _, t in items]
    rows = [r for r in rows if not any(all(len(p & own[r[0]]) >= 0.8 * len(p) for p in ps) for ps in parts)]
    # Mixing: copies as the report of the same rows has them.
    source = spark.createDataFrame(rows, schema)
    sizes = mixing.sizes_of(source)
    plan = mixing.with_copies(sizes, mixing.plan(sizes)).select("doc_id", "__times").collect()
    times = {r["doc_id"]: r["__times"] for r in plan}
    encoder = token_parquet.TextEncoder(token_parquet.default_tokenizer())
    want, start = [], 0
    for i, text, *_ in sorted(rows):
        for _ in range(times[i]):
            ids = [*encoder.encode((text or "").encode()).tolist(), 2]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == want and Counter(r[0] for r in got) == Counter({i: n for i, n in times.items() if n})


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels, items = tables()
    df = spark.createDataFrame([(*r, r[0]) for r in docs[:60]], "doc_id long, text string, lang string, source string, n_chars long, rank long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (df, df.where("false")):
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert sorted(out.columns) == sorted(df.columns) and out.count() <= 3 * rows.count()


def test_texts_that_share_an_id_keep_their_own_fate(spark):
    """Only near copies are merged, and of those the smallest id stays; clean texts under one id all stay."""
    random.seed(4)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(5)]
    near = texts[0].split()
    near[30] = "changed"
    rows = [(1, texts[0]), (1, texts[1]), (2, " ".join(near)), (0, texts[2]), (3, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[1])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, "").collect()), key=str)
    assert got == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (None, texts[3]), (None, texts[4])], key=str)
