"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class, before). Words are put into classes: the
CLUSTERED most frequent words by k-means on what stands one and two places before them, all others
by the class that words of the same ending mostly have. Every word is hashed into one of SLOTS slots
of its class. P(class | before) is a softmax over hashed features of the words before: the n-gram
(word slot one back, and its class), the skip (class of the word two back), both together hashed into
PAIR_SLOTS, and a bias. P(word | class, before) is a softmax over the words of the class;
its features are the word itself, whose weight is its smoothed count, and for the TOP most frequent
words the n-gram with the word slot one back.

Counts, statistics and gradients cover all training documents: a pass counts words, one gathers the
neighbours of frequent words, one how often each class, and each TOP word, follows its contexts. Each
gradient update of the class weights sums over these statistics, which lie spread over tasks; the
weights within classes need only the statistics of their own word slot, so a task updates them by
itself. Scoring looks words up in numpy batches; the HEAD most frequent words are broadcast (a bound
on the table), the counts of all others are joined by bucket of the word's hash, packed as arrays.

Rows with crc32(doc_id as text) mod 5 = 1 are held out of all of this.

Defined results for odd rows: a null text is empty, one end token; repeated rows are rows of their
own; a null doc_id is trained on; without training tokens every token is unknown and both scores
count log10 of 0.5 over 0.5 * 1; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut, free_shuffles
from seqspark.llm.suffix_dedup import pack, unpack

FOLDS, FOLD = 5, 1
HEAD, CLUSTERED, ANCHORS = 200_000, 32_768, 64
CLUSTERS, ENDING_CLASSES, ENDING = 48, 16, 3
CLASSES = CLUSTERS + ENDING_CLASSES
#: Word slots of a class. Contexts are a slot one back and a class two back, the last of each for no word.
SLOTS = 8
NEAR, FAR = CLASSES * SLOTS + 1, CLASSES + 1
#: Slots of both together; words with n-gram weights within their class; updates and shrinking of both softmaxes.
PAIR_SLOTS, TOP, UPDATES, INNER_UPDATES, SHRINK, MOMENTUM = 1 << 11, 4096, 12, 15, 1.0, 0.5
END = b" "  # no word holds a blank
WORDS_KEPT, FLUSH_WORDS, BUCKET_WORDS = 250_000, 400_000, 500_000
#: Packed sums added up at once; parts of the sums of a task, and of those by word slot (a divisor of NEAR).
FAN, BLOCKS, INNER_BLOCKS = 128, 48, 27


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _count(batches):
    counts: Counter = Counter()

    def rows():
        frame = pd.DataFrame({"word": list(counts.keys()), "c": list(counts.values())})
        counts.clear()
        return frame

    for pdf in batches:
        for text in pdf["text"]:
            counts.update(tokens(text))
            if len(counts) > FLUSH_WORDS:
                yield rows()
    yield rows()


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c) over all training tokens."""
    return cut(train.mapInPandas(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def ending(word: bytes) -> bytes:
    """What decides the class of a word outside the clustered ones: its last bytes."""
    return word[-ENDING:]


class Places(dict):
    """word -> number; words outside the table get other(word), kept up to a bound."""

    def __init__(self, table: dict[bytes, int], other) -> None:
        super().__init__(table)
        self.other, self.bound = other, len(table) + WORDS_KEPT

    def __missing__(self, word: bytes) -> int:
        number = self.other(word)
        if len(self) < self.bound and len(word) < 64:
            self[word] = number
        return number

    def of(self, batch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers (from 0 on) of the batch's tokens, where its texts start, and the tokens."""
        lists = [tokens(t) for t in batch]
        starts = np.cumsum([0] + [len(x) for x in lists])
        words = list(chain.from_iterable(lists))
        numbers = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        for i in np.nonzero(numbers < 0)[0].tolist():
            numbers[i] = self[words[i]]
        return numbers, starts, words


def _slices(pdf: pd.DataFrame, most: int = 1 << 20):
    """Row ranges of about most bytes of text."""
    at = size = 0
    for i, t in enumerate(pdf["text"]):
        size += len(t or b"")
        if size > most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(pdf):
        yield at, len(pdf)


def _before(numbers: np.ndarray, starts: np.ndarray, k: int, none: int) -> np.ndarray:
    """The number k places before each token of the same text, none where there is none."""
    out = np.full(len(numbers), none, numbers.dtype)
    out[k:] = numbers[:-k]
    for i in range(k):
        at = starts[:-1] + i
        out[at[at < starts[1:]]] = none
    return out


def _sums(key_count: int, keys_of, blocks: int):
    """Map step: sums of keys over a task, dealt out in packed rows of equal parts."""

    def add(batches):
        total = np.zeros(key_count, np.int32)
        for pdf in batches:
            for a, b in _slices(pdf):
                np.add.at(total, keys_of(pdf["text"].iloc[a:b]), 1)
        size = -(-key_count // blocks)
        part = TaskContext.get().partitionId()
        for k in range(blocks):
            data = pack(total[k * size : (k + 1) * size].astype(np.int64))
            yield pd.DataFrame({"block": [k], "part": [part], "data": [data]}).astype({"block": "int32", "part": "int32"})

    return add


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(unpack(x, "<i8")[0] for x in pdf["data"])
    return pdf.iloc[:1].assign(data=[pack(total)])


def _gathered(train: DataFrame, key_count: int, keys_of, blocks: int = BLOCKS) -> DataFrame:
    """The sums in rows of one block each. They are added up as a tree, FAN at a time, so no step holds
    more than FAN packed rows, however many tasks there are."""
    schema = "block int, part int, data binary"
    sums = cut(train.mapInPandas(_sums(key_count, keys_of, blocks), schema), "sums")
    while (sums.agg(F.max("part")).first()[0] or 0) > 0:
        sums = sums.withColumn("part", F.expr(f"CAST(part div {FAN} AS int)")).groupBy("block", "part").applyInPandas(_add_up, schema)
        sums = cut(sums, "sums")
    return sums


def _joined(sums: DataFrame) -> np.ndarray:
    """The sums on the driver: a model-sized array, whatever the input."""
    return np.concatenate([unpack(r["data"], "<i8")[0] for r in sums.orderBy("block").collect()] or [np.zeros(0, np.int64)])


def cluster(neighbours: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means of words on square roots of their neighbours' shares, weighted by count."""
    x = np.sqrt(neighbours + 0.05)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng(5)
    centres = x[:k] if len(x) <= k else x[rng.choice(len(x), k, replace=False, p=np.sqrt(weight) / np.sqrt(weight).sum())]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x * np.sqrt(weight)[:, None])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return label


class Classes:
    """word -> class: a table for the clustered words, endings for all others."""

    def __init__(self, words: list[bytes], counts: np.ndarray, neighbours: np.ndarray) -> None:
        label = cluster(neighbours, counts.astype(float), CLUSTERS) if len(words) else np.zeros(0, np.int64)
        self.table = dict(zip(words, label.tolist(), strict=True))
        # Other words: clusters are merged into ENDING_CLASSES groups; an ending takes the group that
        # most of its clustered words are in, rare words counting as much as frequent ones.
        sums = np.zeros((CLUSTERS, neighbours.shape[1]))
        np.add.at(sums, label, neighbours)
        group = cluster(sums, sums.sum(1) + 1, ENDING_CLASSES)
        votes: dict[bytes, Counter] = {}
        for word, k in self.table.items():
            for n in range(1, ENDING + 1):
                votes.setdefault(word[-n:], Counter())[int(group[k])] += 1
        self.endings = {e: min(v, key=lambda k: (-v[k], k)) for e, v in votes.items()}

    def of(self, word: bytes) -> int:
        k = self.table.get(word)
        if k is not None:
            return k
        end = ending(word)
        while end and end not in self.endings:
            end = end[1:]
        return CLUSTERS + self.endings.get(end, 0)


#: Where each kind of class feature starts: bias, class and slot one back, class two back, both together hashed.
_FIRST = np.cumsum([0, 1, CLASSES + 1, NEAR, FAR, PAIR_SLOTS])
N_FEATURES = int(_FIRST[-1])


def _pairs(far: int) -> np.ndarray:
    """Hashed slots of the class two back together with each word slot one back."""
    mixed = np.arange(NEAR, dtype=np.uint64) * np.uint64(0x9E3779B1) + np.uint64(far + 1) * np.uint64(0x85EBCA77)
    return ((mixed >> np.uint64(7)) % np.uint64(PAIR_SLOTS)).astype(np.int64)


def log_classes(weights: np.ndarray, far: int) -> np.ndarray:
    """Natural log of P(class | context) for the contexts of one class two back, a sum of hashed weights."""
    part = [weights[_FIRST[k] : _FIRST[k + 1]] for k in range(5)]
    score = part[2] + part[1][np.arange(NEAR) // SLOTS] + part[4][_pairs(far)] + (part[0][0] + part[3][far])
    score -= score.max(axis=1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=1, keepdims=True))


def _add_features(out: np.ndarray, values: np.ndarray, far: int) -> None:
    """Add values (contexts of one class two back, classes) to the features of each context."""
    every = values.sum(axis=0)
    out[_FIRST[0]] += every
    out[_FIRST[1] : _FIRST[2]] += np.add.reduceat(values, np.arange(0, NEAR, SLOTS), axis=0)
    out[_FIRST[2] : _FIRST[3]] += values
    out[_FIRST[3] + far] += every
    np.add.at(out, _FIRST[4] + _pairs(far), values)


def _gradients(weights):
    """Map step: gradient and curvature summed over the contexts of a task."""

    def step(batches):
        out, any_ = np.zeros((2, N_FEATURES, CLASSES)), False
        for pdf in batches:
            for far, data in zip(pdf["block"], pdf["data"], strict=True):
                n = unpack(data, "<i8")[0].reshape(NEAR, CLASSES)
                if not n.any():
                    continue
                any_ = True
                total = n.sum(axis=1, keepdims=True)
                p = np.exp(log_classes(weights.value, far))
                _add_features(out[0], n - total * p, far)
                _add_features(out[1], total * p * (1 - p), far)
        if any_:
            yield pd.DataFrame({"data": [pack(out.astype(np.float32).ravel())]})

    return step


def train(stats: DataFrame, class_counts: np.ndarray) -> np.ndarray:
    """Weights (feature, class) from the packed statistics, by damped Newton steps on the diagonal; the
    bias starts at the classes' own shares."""
    spark = stats.sparkSession
    weights = np.zeros((N_FEATURES, CLASSES))
    weights[0] = np.log(class_counts + 0.5) - np.log(class_counts.sum() + 1)
    step = np.zeros_like(weights)
    for _ in range(UPDATES):
        shared = spark.sparkContext.broadcast(weights.astype(np.float32))
        slope, curve = -SHRINK * weights, np.full_like(weights, SHRINK)
        slope[0] = 0.0  # the bias is not shrunk
        for r in stats.mapInPandas(_gradients(shared), "data binary").collect():  # a model-sized row for each of the few tasks
            g, h = unpack(r["data"], "<f4")[0].reshape(2, N_FEATURES, CLASSES)
            slope += g
            curve += h
        # Five features meet in each context, so a full step on each would go five times too far; steps keep some momentum.
        step = np.clip(slope / curve / 5, -1, 1) + MOMENTUM * step
        weights = weights + step
        shared.unpersist()
    return weights


def inner_weights(n: np.ndarray, base: np.ndarray, kind: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (word slot, TOP word) and the natural log of the classes' sums in each word slot.

    n: counts (word slot, TOP words and then the classes' other words); base: each word's share of its
    class; kind: its class; rest: what share of each class other words have. Damped Newton steps."""
    some = np.zeros((len(kind), CLASSES))
    some[np.arange(len(kind)), kind] = 1
    seen = n[:, : len(kind)].astype(float)
    total = (seen @ some + n[:, len(kind) :])[:, kind]
    weights = np.zeros_like(seen)

    def sums():
        return (base * np.exp(weights)) @ some + rest

    for _ in range(INNER_UPDATES):
        p = base * np.exp(weights) / sums()[:, kind]
        weights += np.clip((seen - total * p - SHRINK * weights) / (total * p * (1 - p) + SHRINK), -1, 1)
    return weights, np.log(sums())


def _inner(model):
    """Map step: the weights within classes of the word slots in each packed row."""

    def step(batches):
        base, kind, rest = model.value
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"], strict=True):
                n = unpack(data, "<i8")[0].reshape(-1, len(kind) + CLASSES)
                weights, sums = inner_weights(n, base, kind, rest)
                yield pd.DataFrame({"block": [block], "data": [pack(weights.astype(np.float32).ravel(), sums.astype(np.float32).ravel())]})

    return step


class Model:
    """All that scoring needs; its size does not depend on the input."""

    def __init__(self, docs: DataFrame) -> None:
        """docs(doc_id, text)."""
        spark = docs.sparkSession
        rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        train_rows = rows.where(~held_out(F.col("doc_id"))).select("text")
        self.counts = word_counts(train_rows)
        self.n, self.v = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        top = self.counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
        words, counts = top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.int64)

        some = words[:CLUSTERED]
        self.numbers = spark.sparkContext.broadcast({w: i for i, w in enumerate(some)})
        neighbours = _joined(_gathered(train_rows, max(1, len(some)) * ANCHORS, _neighbour_keys(self.numbers))) if some else np.zeros(ANCHORS)
        self.classes = Classes(some, counts[:CLUSTERED], neighbours.reshape(-1, ANCHORS)[: len(some)])
        shared = spark.sparkContext.broadcast((self.classes, {w: i for i, w in enumerate(words[:TOP])}))
        top = len(words[:TOP])
        stats = _gathered(train_rows, FAR * NEAR * CLASSES, _context_keys(shared), FAR).repartition(BLOCKS // 4, "block")
        inner = _gathered(train_rows, NEAR * (top + CLASSES), _inner_keys(shared), INNER_BLOCKS).repartition(BLOCKS // 4, "block")
        free_shuffles(spark)
        sizes = self.counts.mapInPandas(_class_of(shared), "class int, c long").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
        known, distinct = np.zeros((2, CLASSES))
        for r in sizes.collect():
            known[r["class"]], distinct[r["class"]] = r["n"], r["v"]
        self.class_sum = known + 0.5 * (distinct + 1)
        self.base_sum = self.n + 0.5 * (self.v + 1)
        weights = train(cut(stats, "stats"), known)
        self.log_class = np.concatenate([log_classes(weights, far) for far in range(FAR)]).astype(np.float32) / np.float32(np.log(10))

        # Each head word's slot and count; number len(words) + slot stands for any other word of that slot.
        self.head = {w: i for i, w in enumerate(words)}
        slot = np.array([slot_of(self.classes.of(w), w) for w in words], np.int32)
        self.slot = np.concatenate([slot, np.arange(NEAR - 1, dtype=np.int32)])
        kind = slot // SLOTS
        self.base = np.concatenate([np.log10((counts + 0.5) / self.base_sum), np.zeros(NEAR - 1)])
        inside = (counts + 0.5) / self.class_sum[kind]
        self.inside = np.concatenate([np.log10(inside), np.zeros(NEAR - 1)])
        self.top = top
        share = np.bincount(kind[:top], inside[:top], minlength=CLASSES)
        given = spark.sparkContext.broadcast((inside[:top], kind[:top], np.maximum(1 - share, 1e-12)))
        self.inner, self.inner_sums = np.zeros((NEAR, top), np.float32), np.zeros((NEAR, CLASSES), np.float32)
        for r in cut(inner, "inner").mapInPandas(_inner(given), "block int, data binary").toLocalIterator():  # NEAR rows of TOP numbers
            own, sums = unpack(r["data"], "<f4", "<f4")
            at = slice(r["block"] * (NEAR // INNER_BLOCKS), (r["block"] + 1) * (NEAR // INNER_BLOCKS))
            self.inner[at], self.inner_sums[at] = own.reshape(NEAR // INNER_BLOCKS, top) / np.log(10), sums.reshape(-1, CLASSES) / np.log(10)


def slot_of(kind: int, word: bytes) -> int:
    """A word's hashed slot within the slots of its class."""
    return kind * SLOTS + zlib.crc32(word) % SLOTS


def _neighbour_keys(numbers):
    places: list[Places] = []

    def keys(texts) -> np.ndarray:
        if not places:
            places.append(Places(numbers.value, lambda w: len(numbers.value)))
        own, starts, _ = places[0].of(texts)
        own[own == len(numbers.value)] = -1
        out = []
        for k in (1, 2):
            prior = _before(own, starts, k, -1)
            use = (own >= 0) & (prior >= 0) & (prior < ANCHORS)
            out.append(own[use].astype(np.int64) * ANCHORS + prior[use])
        return np.concatenate(out)

    return keys


def _contexts(slot: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, word slot one back) of every token."""
    one, two = (_before(slot, starts, k, NEAR - 1).astype(np.int64) for k in (1, 2))
    return two // SLOTS * NEAR + one, one


def _slots(shared) -> Places:
    classes, top = shared.value
    return Places({}, lambda w: slot_of(classes.of(w), w) + NEAR * (1 + top.get(w, -1)))


def _context_keys(shared):
    places: list[Places] = []

    def keys(texts) -> np.ndarray:
        if not places:
            places.append(_slots(shared))
        code, starts, _ = places[0].of(texts)
        slot = code % NEAR
        return _contexts(slot, starts)[0] * CLASSES + slot // SLOTS

    return keys


def _inner_keys(shared):
    places: list[Places] = []

    def keys(texts) -> np.ndarray:
        if not places:
            places.append(_slots(shared))
        code, starts, _ = places[0].of(texts)
        top, slot = np.divmod(code, NEAR)
        n = len(shared.value[1])
        return _contexts(slot, starts)[1] * (n + CLASSES) + np.where(top > 0, top - 1, n + slot // SLOTS)

    return keys


def _class_of(shared):
    def add(batches):
        classes = shared.value[0]
        for pdf in batches:
            yield pd.DataFrame({"class": np.array([classes.of(w) for w in pdf["word"]], np.int32), "c": pdf["c"]})

    return add


DOC, TAIL = 0, 1
SCORED = "kind int, bucket int, data binary, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _score(model, buckets: int):
    """Map step: per document what classes and head words give, and the other words by bucket."""

    def score(batches):
        import xxhash

        own = model.value
        head = len(own.slot) - (NEAR - 1)
        places = Places(own.head, lambda w: head + slot_of(own.classes.of(w), w))
        row = TaskContext.get().partitionId() << 40
        for pdf in batches:
            for a, b in _slices(pdf):
                part = pdf.iloc[a:b]
                number, starts, every = places.of(part["text"])
                slot, n = own.slot[number], len(part)
                kind = slot // SLOTS
                context, one = _contexts(slot, starts)
                given = own.log_class[context, kind] - own.inner_sums[one, kind]
                top = np.nonzero(number < own.top)[0]
                given[top] += own.inner[one[top], number[top]]
                text = np.repeat(np.arange(n), np.diff(starts))
                total = lambda x, text=text, n=n: np.bincount(text, x, minlength=n)
                tail = number >= head
                yield _frame(
                    n, kind=DOC, bucket=-1, data=None, row=row + np.arange(n), doc_id=part["doc_id"].to_numpy(), held_out=part["held_out"].to_numpy(),
                    n_tokens=np.diff(starts), n_known=total(~tail).astype(np.int64), base=total(own.base[number]), score=total(given + own.inside[number]),
                )
                at = np.nonzero(tail)[0]
                words = [every[i] for i in at.tolist()]
                hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                cuts = np.nonzero(np.diff(bucket[order]))[0] + 1
                data = [(int(bucket[x[0]]), pack(hashes[x], row + text[at[x]], kind[at[x]].astype(np.uint8))) for x in np.split(order, cuts) if len(x)]
                yield _frame(len(data), kind=TAIL, bucket=[k for k, _ in data], data=[x for _, x in data])
                row += n

    return score


def _frame(n: int, **columns) -> pd.DataFrame:
    names = [x.split()[0] for x in SCORED.split(", ")]
    frame = pd.DataFrame({c: columns.get(c) for c in names}, index=range(n))
    return frame.astype({"doc_id": "Int64", "row": "Int64", "n_tokens": "Int64", "n_known": "Int64", "held_out": "boolean", "base": float, "score": float, "kind": "int32", "bucket": "int32"})


def _look_up(base_sum: float, class_sum: np.ndarray, groups: int):
    """Cogroup step over one bucket: other words' counts, sent back as sums per document."""

    def look_up(words, counts):
        if not len(words):
            return pd.DataFrame({"bucket": np.zeros(0, np.int32), "data": []})
        hashes, row, kind = (np.concatenate(x) for x in zip(*(unpack(x, "<u8", "<i8", "u1") for x in words["data"]), strict=True))
        name, count = counts["h"].to_numpy(np.int64).view(np.uint64), counts["c"].to_numpy(np.int64)
        order = np.argsort(name)
        name, count = name[order], count[order]
        c = np.zeros(len(hashes), np.int64)
        if len(name):
            at = np.minimum(np.searchsorted(name, hashes), len(name) - 1)
            c = np.where(name[at] == hashes, count[at], 0)
        docs, slot = np.unique(row, return_inverse=True)
        sums = [np.bincount(slot, x) for x in (c > 0, np.log10((c + 0.5) / base_sum), np.log10((c + 0.5) / class_sum[kind]))]
        group = docs % groups
        order = np.argsort(group, kind="stable")
        parts = np.split(order, np.nonzero(np.diff(group[order]))[0] + 1)
        return pd.DataFrame({"bucket": np.array([group[x[0]] for x in parts], np.int32), "data": [pack(docs[x], *(s[x] for s in sums)) for x in parts]})

    return look_up


REPORT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(docs, sums):
    """Cogroup step over a group of documents: head sums plus the other words' sums."""
    docs = docs.sort_values("row", ignore_index=True)
    parts = [unpack(x, "<i8", "<f8", "<f8", "<f8") for x in sums["data"]]
    extra = np.zeros((3, len(docs)))
    if parts:
        row, *more = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.searchsorted(docs["row"].to_numpy(np.int64), row)
        extra = np.stack([np.bincount(at, x, minlength=len(docs)) for x in more])
    return pd.DataFrame(
        {"doc_id": docs["doc_id"].astype("Int64"), "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": docs["n_known"] + extra[0].astype(np.int64), "base_score": docs["base"] + extra[1], "score": docs["score"] + extra[2]}
    )


def report(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = Model(docs)
    buckets = int(max(12, model.n // BUCKET_WORDS))
    counts, n, base_sum, class_sum = model.counts, model.n, model.base_sum, model.class_sum
    model.counts = model.numbers = None
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = cut(rows.mapInPandas(_score(shared, buckets), SCORED), "scored")
    free_shuffles(spark)
    # The hash is an unsigned number dealt out by its remainder; Spark's is the same one, signed.
    hashed = counts.select(F.xxhash64("word").alias("h"), "c")
    remainder = F.pmod(F.pmod(F.col("h"), F.lit(buckets)) + F.when(F.col("h") < 0, F.lit((1 << 64) % buckets)).otherwise(0), F.lit(buckets))
    hashed = hashed.withColumn("bucket", remainder.cast("int"))
    tails = scored.where(F.col("kind") == TAIL).select("bucket", "data").groupBy("bucket").cogroup(hashed.groupBy("bucket"))
    groups = buckets
    sums = tails.applyInPandas(_look_up(base_sum, class_sum, groups), "bucket int, data binary")
    own = scored.where(F.col("kind") == DOC).select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", F.pmod("row", F.lit(groups)).cast("int").alias("bucket"))
    done = own.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInPandas(_finish, REPORT)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
