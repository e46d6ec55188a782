import math
import random
import re
from collections import Counter

from seqspark.llm import license_scan as ls

TEXTS = [
    "Released under the MIT License.\nFoo MIT-license mit  LICENSE; emit license; mit licenses",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0. cc by", "Licensed under the Apache License, Version 2.0.", "ccby cc_by é cc by é", "écc by", "cc byé cc by1", "gnu general public", "words of the license only", None, "", "...", "mit license " * 3000,
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that nothing", "İMIT LICENSE mit license",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in ls.PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))


def test_scan(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], "x")]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    labels = {r["doc_id"]: r["labels"] for r in got if r["doc_id"] is not None}
    assert labels[0] == "mit" and labels[1] == "gpl,gpl-3.0" and labels[3] == "apache,apache-2.0" and labels[13] == "bsd" and labels[8] == ""
    assert "cc-by-nc-4.0" in labels[2] and all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def brute_labels(texts):
    """(labels, score) of every text, template by template."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    df = Counter(w for own in words for w in set(own))
    idf = {w: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for text, own in zip(texts, words, strict=True):
        labels, score = set(filter(None, brute(text)[4].split(","))), 0.5 if brute(text)[1] else 0.0
        for label, key, template in ls.TEMPLATES:
            at = ls.indexed(template)
            top = sorted({w for w, _ in at} & set(own), key=lambda w: (-idf[w], w))[: ls.TOP]
            shifts = Counter(s for s, _ in {(i - k, w) for i, w in enumerate(own) for v, k in at if v == w and w in top})
            coverage = min(1.0, max(shifts.values(), default=0) / min(ls.TOP, len({w for w, _ in at})))
            if coverage >= ls.SUPPORT and f" {key} " in f" {' '.join(own)} ":
                labels.add(label)
                score = max(score, coverage)
        out.append((",".join(sorted(labels)), round(score, 6)))
    return out


def test_labels_and_scores_against_brute_force(spark):
    random.seed(12)
    notices = [t for _, _, t in ls.TEMPLATES]
    texts = [*TEXTS, " and then ".join(notices)]
    for _ in range(60):
        own = random.choice(notices).split()
        at = random.randrange(len(own))
        texts.append(" ".join(random.choices(["lorem", "ipsum", "the", "license"], k=9) + own[at // 2 : at // 2 + random.randint(3, 60)] + random.choices(own, k=5)))
    got = ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).select("doc_id", "labels", "score").collect()
    assert sorted(map(tuple, got)) == [(i, *x) for i, x in enumerate(brute_labels(texts))]


def test_every_template_is_found_alone_and_among_others(spark):
    notices = [(k, text, label) for k, (label, _, text) in enumerate(ls.TEMPLATES)]
    rows = [(k, t) for k, t, _ in notices] + [(100, ". ".join(t for _, t, _ in notices)), (101, ". ".join(t for _, t, _ in reversed(notices)))]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k] for k, _, label in notices)
    assert got[100] == got[101] == {label for _, _, label in notices} | set(ls.PHRASES.values())


def test_plan_has_no_python(spark):
    plan = ls.scan(spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
