"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text (see FEATURES): densities of lexicon words and stems, their weights, how near
they stand to second-person words, capitals, punctuation and obfuscation. The lexicon is learned
from all labelled training rows: words and word stems whose share among toxic texts exceeds that
among others by far; it is joined with a short list of English insults. An entry stands in MIN_DOCS
toxic texts at least and in min_share of them (MIN_SHARE: one in 10,000, whatever the size of the
table). Before the lexicon is sent to the workers its bytes are checked against LEXICON_BYTES. Trees and calibration are fitted on
all of these rows, equal ones once.

Rows with crc32(doc_id as text) mod 5 = 0 are held out: their labels are never read. Of the rest,
a hash of the id sets a fifth of the rows aside for calibration.

Defined results for odd rows: a null text is scored as an empty one; repeated rows get the same
score; a row with a null doc_id is scored and not learned from; a document with both labels counts
as toxic; texts that share an id are all learned from; without labelled rows of both kinds every score is the toxic share, 0.0 if there are
none; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut

#: Support of a lexicon entry among toxic texts, and its log odds; labelled rows of a partition that trees are fitted on, about.
MIN_DOCS, MIN_SHARE, MIN_LOG_ODDS, PART_ROWS = 5, 1e-4, 3.0, 20_000
FOLDS, STEM_SIZES, NEAR, WORDS_KEPT, ENTRIES_KEPT, FIELDS = 5, (4, 5, 6), 5, 250_000, 300_000, 7
ROUNDS, DEPTH = 20, 4
#: Most bytes of the lexicon in a worker, and what an entry takes there besides its text.
LEXICON_BYTES, ENTRY_BYTES = 256 << 20, 150

#: Insults, and words for the second person in four languages.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown fool dumb imbecile jerk".split()
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted tú ti tus vosotros su".split()
#: Digits and signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")

FEATURES = ("log_words", "word_hits", "word_density", "stem_hits", "stem_density", "weight_sum", "weight_max", "weight_density", "hits_near_person", "share_near_person", "person_density", "capitals", "all_caps_words", "exclamations", "punctuation", "repeated_marks", "digits", "disguised_hits", "mixed_words", "mean_word")

_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(rb"([!?.*#$%&])\1+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def entries(word: str) -> list[str]:
    """Lexicon keys of a lower-case word: itself and its stems, which end in an asterisk."""
    return [word] + [word[:n] + "*" for n in STEM_SIZES if len(word) > n]


class Words(dict):
    """raw word -> row of (word hits, stem hits, weight, second person, all caps, disguised, mixed). A raw
    word holds any number of runs of letters; each counts."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat = array("d")

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        found = _LETTERS.findall(word.lower())
        weight = hit = stem = person = 0
        for x in found:
            keys = [self.lexicon.get(k, 0.0) for k in entries(x)]
            weight, hit, stem = max(weight, *keys), hit + (keys[0] > 0), stem + (max(keys[1:], default=0) > 0)
            person = person or x in _PERSONS
        bare = word.strip(".,;:!?\"'()[]")
        mixed = bare != "" and not bare.isalpha() and any(map(str.isalpha, bare))
        disguised = False
        if mixed and not hit and not stem:
            plain = "".join(_LETTERS.findall(bare.lower().translate(DISGUISE)))
            disguised = self.lexicon.get(plain, 0.0) > 0
        place = len(self.flat) // FIELDS
        self.flat.extend((hit, stem, weight, person, len(bare) > 2 and bare.isupper(), disguised, mixed))
        if len(raw) < 64:
            self[raw] = place
        return place

    def table(self, raw: list[bytes]) -> np.ndarray:
        """FIELDS columns for each word."""
        if len(self.flat) > FIELDS * WORDS_KEPT:
            self.forget()
        places = np.fromiter(map(self.get, raw, repeat(-1)), np.int64, len(raw))
        for i in np.nonzero(places < 0)[0].tolist():
            places[i] = self[raw[i]]
        return np.frombuffer(self.flat, np.float64).reshape(-1, FIELDS)[places]


_PERSONS = frozenset(SECOND_PERSON)
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(text: bytes | None, words: Words) -> list[float]:
    text = text or b""
    raw = text.split()
    tables = [words.table(raw[at : at + 50_000]) for at in range(0, len(raw), 50_000)]
    n, size = max(1, len(raw)), max(1, len(text))
    hit, stem, weight, person, caps, disguised, mixed = (np.concatenate(tables) if tables else np.zeros((0, FIELDS))).T
    marked = np.nonzero((hit + stem + disguised) > 0)[0]
    persons = np.nonzero(person)[0]
    near = 0
    if len(marked) and len(persons):
        at = np.searchsorted(persons, marked)
        gap = np.minimum(np.abs(persons[np.minimum(at, len(persons) - 1)] - marked), np.abs(marked - persons[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    codes = np.frombuffer(text, np.uint8)
    count = lambda kind: int(kind[codes].sum())
    return [
        math.log1p(len(raw)), hit.sum(), hit.sum() / n, stem.sum(), stem.sum() / n, weight.sum(), weight.max(initial=0), weight.sum() / n,
        near, near / max(1, len(marked)), person.sum() / n, count(_CAPITAL) / size, caps.sum() / n, text.count(b"!") / size, count(_MARK) / size,
        len(_RUNS.findall(text)) / n, count(_DIGIT) / size, disguised.sum(), mixed.sum() / n, size / n,
    ]


def with_features(docs: DataFrame, lexicon, *keep: str) -> DataFrame:
    """docs(doc_id, text, ...) as (doc_id, keep, features array<double>); lexicon: a broadcast dict."""

    def compute(batches):
        words = Words(lexicon.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), **{c: pdf[c] for c in keep}, "features": [[float(x) for x in features(t, words)] for t in pdf["text"]]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("text"))
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInPandas(compute, f"doc_id long, {kinds}features array<double>")


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled rows that are not held out, (doc_id, text, toxic).

    The marks are a written table, so Spark knows their size and broadcasts them only where they are small."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = cut(marks.where(~held_out(F.col("doc_id"))), "marks")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, "doc_id")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """labelled_rows(), equal ones once."""
    return labelled_rows(docs, labels).dropDuplicates(["doc_id", "text"])


def _entry_counts(batches):
    """Documents of either kind that hold a lexicon entry, summed within the task as far as memory allows."""
    clean, toxic = counts = (Counter(), Counter())

    def rows():
        names = list(clean.keys() | toxic.keys())
        frame = pd.DataFrame({"entry": pd.Series(names, dtype="object"), "clean": [clean[x] for x in names], "toxic": [toxic[x] for x in names]})
        for c in counts:
            c.clear()
        return frame.astype({"clean": "int64", "toxic": "int64"})

    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
            words = set(_LETTERS.findall((text or "").lower()))
            counts[bool(label)].update({k for w in words for k in entries(w)})
            if len(clean) + len(toxic) > ENTRIES_KEPT:
                yield rows()
    if clean or toxic:
        yield rows()


def learn_lexicon(rows: DataFrame, min_share: float = MIN_SHARE) -> dict[str, float]:
    """entry -> log odds, of all rows(text, toxic); raises where the entries exceed LEXICON_BYTES."""
    lexicon = {w: 2.0 for w in INSULTS}
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return lexicon
    counts = rows.mapInPandas(_entry_counts, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1.0)) - F.log((F.col("c") + 0.5) / (n[0] + 1.0))
    best = counts.where(F.col("t") >= max(MIN_DOCS, min_share * n[1])).select("entry", odds.alias("odds")).where(F.col("odds") >= MIN_LOG_ODDS)
    best = cut(best, "lexicon")
    size = best.agg(F.sum(F.octet_length("entry") + ENTRY_BYTES)).first()[0] or 0
    if size > LEXICON_BYTES:
        raise ValueError(f"the lexicon takes {size} bytes in every worker, more than {LEXICON_BYTES}; raise min_share")
    return lexicon | {r["entry"]: r["odds"] for r in best.collect()}


class Model:
    """A fitted model: lexicon, trees, calibration; or a constant where nothing can be learned."""

    def __init__(self, docs: DataFrame, labels: DataFrame) -> None:
        self.trees = None
        rows = labelled_rows(docs, labels)
        self.lexicon = docs.sparkSession.sparkContext.broadcast(learn_lexicon(rows.select("text", "toxic")))
        # Equal rows go by a hash of their text, once features stand for it: no text is shuffled.
        fed = with_features(rows.withColumn("digest", F.xxhash64("text")), self.lexicon, "digest", "toxic").dropDuplicates(["doc_id", "digest"])
        fed = cut(fed.sortWithinPartitions("doc_id", "digest"), "features")
        counts = {r["toxic"]: r["count"] for r in fed.groupBy("toxic").count().collect()}
        self.constant = counts.get(1, 0) / max(1, sum(counts.values()))
        if not counts.get(1) or not counts.get(0):
            return
        # Each round of boosting is a few jobs over feature rows, in no more partitions than they need.
        fed = fed.coalesce(max(4, sum(counts.values()) // PART_ROWS)).withColumn("toxic", F.col("toxic").cast("double"))
        fed = fed.select("doc_id", array_to_vector("features").alias("features"), "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0).alias("aside"))
        booster = GBTClassifier(featuresCol="features", labelCol="toxic", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.2, seed=7, cacheNodeIds=False)
        learn = fed.where("NOT aside")
        if learn.select("toxic").distinct().count() < 2:
            learn = fed
        self.trees = booster.fit(learn)
        aside = self._raw(fed.where("aside"))
        self.calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic").fit(aside) if aside.select("toxic").distinct().count() == 2 else None

    def _raw(self, rows: DataFrame) -> DataFrame:
        out = self.trees.transform(rows)
        return out.withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row of docs."""
        if self.trees is None:
            return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(self.constant)).alias("score"))
        rows = with_features(docs, self.lexicon).select("doc_id", array_to_vector("features").alias("features"))
        rows = self._raw(rows).select("doc_id", "raw")
        if self.calibration is None:
            return rows.withColumnRenamed("raw", "score")
        # Isotonic steps tie many texts; a thousandth of the raw score keeps their order.
        calibrated = self.calibration.transform(rows)
        return calibrated.select("doc_id", (F.col("prediction") * 0.999 + F.col("raw") * 0.001).alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    scored = Model(docs, labels).score(docs)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
