"""Benchmark decontamination: every passage of every document queries a BM25 index of test items.

The index holds, for each term, the items that have it with their impacts: BM25 weights divided by
the item's own total, so that an item's full text scores 1. Each item has its own threshold: the
least score that a passage can have which holds OVERLAP of the item's shingles (each missing word
costs a shingle at least, so it is 1 less the largest impacts of as many words as shingles may be
missing). So retrieval loses no leak, and whether an item is a leak depends on no other item.

Search is block-max WAND, for all passages of some texts at once. Posting lists are in order of
items and cut into blocks of BLOCK items with the largest impact of each. (1) A passage's terms are
put in order of falling frequency; up to the pivot their largest impacts stay below the threshold
together, so an item must have a term from the pivot on: only blocks of those lists are entered.
(2) A block goes on if the block maxima of all the passage's terms reach the threshold. (3) Items of
such blocks are scored. Every (passage, item) at its threshold is verified: of the word shingles of
the item's question and of its answer, at least OVERLAP must occur in the passage.

Passages are windows of words, half overlapping, of PASSAGE_WORDS or the power of two times that
which is twice the item's length at least; items of one such class have their index in common.

Items without an answer of their own give the last fifth of their words (a shingle at least) as the
answer and the rest as the question. As that cut is arbitrary, they are leaks also where OVERLAP of
the shingles of the whole item occur in such a passage. All items go into one pass over the
documents up to SHARD_BYTES of their text; more take a pass for each SHARD_BYTES. That bounds what is
broadcast: the index is flat arrays, 16 bytes a posting and 4 a word, and a dictionary of the words; the
shingles of an item are made when a passage reaches its threshold, and kept for KEPT items. Document frequencies always count all items.

Defined results for odd rows: null and blank texts and items match nothing; an item of fewer than
SHINGLE words is one shingle; repeated rows of documents give repeated rows, of items one; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.token_parquet import pieces

K1, B = 1.2, 0.75
SHINGLE, OVERLAP = 5, 0.8
PASSAGE_WORDS, BLOCK, SHARD_BYTES, KEPT = 128, 8, 16 << 20, 4096
#: Bytes of text searched at once, and split into words at once; how far sums may be off by rounding.
SLICE_BYTES, PIECE_BYTES, ROUNDING = 4 << 20, 1 << 20, 1e-9
UNKNOWN, PART = -1, -2

#: Lower case for A-Z; white space for every other ASCII byte that is no letter or digit.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_PART = b"\x00"  # no folded text has it
LEAKS = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, first_word long, n_passages int, item_overlap double"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def shingles(words: list, n: int = SHINGLE) -> set:
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)} if words else set()


def _may_miss(wanted: set) -> int:
    return math.floor((1 - OVERLAP) * len(wanted) + ROUNDING)


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its places from starts[term] to starts[term + 1]: (index into terms, place)."""
    sizes = starts[terms + 1] - starts[terms]
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(terms)), sizes)
    return owner, np.arange(len(owner)) + (starts[terms] - ends + sizes)[owner]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their values."""
    names, slot = np.unique(keys, return_inverse=True)
    return names, np.bincount(slot, values, minlength=len(names))


class Class:
    """Block-max index of the items of one passage length: (item_id, question, answer, whether the
    answer was cut off) with words as arrays of numbers, and each item's terms and raw BM25 weights."""

    def __init__(self, passage: int, items: list[tuple], weights: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        self.step = passage // 2
        self.ids = [i for i, *_ in items]
        self.words = np.concatenate([x for _, q, a, _ in items for x in (q, a)])
        self.edges = np.concatenate([[0], np.cumsum([len(x) for _, q, a, _ in items for x in (q, a)])])  # of questions and answers in turn
        self.cut_off = np.array([c for *_, c in items])
        self.kept: dict[int, tuple] = {}
        threshold = []
        for k, (_, raw) in enumerate(weights):
            question, answer, whole = self._shingles(k)
            most = max(_may_miss(question) + _may_miss(answer), _may_miss(whole or set()))
            total = raw.sum()
            # At least one shingle, so one word, is there.
            threshold.append(max(1 - np.sort(raw)[::-1][:most].sum() / total, raw.min() / total))
        self.threshold = np.array(threshold)
        # Impacts divided by the item's threshold: the bound is 1 for all.
        term = np.concatenate([terms for terms, _ in weights])
        item = np.repeat(np.arange(len(items)), [len(terms) for terms, _ in weights])
        value = np.concatenate([raw / raw.sum() / threshold[k] for k, (_, raw) in enumerate(weights)])
        order = np.lexsort((item, term))
        term, self.items, self.values = term[order], item[order], value[order]
        self.starts = np.searchsorted(term, np.arange(n_terms + 1))
        new = np.nonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (self.items[1:] // BLOCK != self.items[:-1] // BLOCK)]))[0]
        self.blocks, self.block_most = self.items[new] // BLOCK, np.maximum.reduceat(self.values, new)
        self.block_starts = np.searchsorted(term[new], np.arange(n_terms + 1))
        self.n_blocks = len(items) // BLOCK + 1
        self.most = np.zeros(n_terms)
        np.maximum.at(self.most, term, self.values)

    def _shingles(self, k: int) -> tuple[set, set, set | None]:
        """Shingles of item k's question, of its answer, and of both where the answer was cut off."""
        a, b, c = self.edges[2 * k : 2 * k + 3]
        words = self.words[a:c].tolist()
        return shingles(words[: b - a]), shingles(words[b - a :]), shingles(words) if self.cut_off[k] else None

    def _parts(self, k: int) -> tuple[set, set, set | None]:
        if k not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[k] = self._shingles(k)
        return self.kept[k]

    def passages(self, words: np.ndarray, begin: np.ndarray):
        """(first passage of each text, passage, term) with each passage's distinct terms in ascending order."""
        at = np.nonzero(words >= 0)[0]
        at = at[self.most[words[at]] > 0]
        text = np.searchsorted(begin, at, "right") - 1
        n = np.maximum(1, -(-np.diff(begin) // self.step) - 1)
        first = np.concatenate([[0], np.cumsum(n)])
        k = (at - begin[text]) // self.step
        own, before = k < n[text], k > 0
        n_terms = len(self.most)
        keys = np.concatenate([(first[text] + k)[own] * n_terms + words[at[own]], (first[text] + k - 1)[before] * n_terms + words[at[before]]])
        return first, *np.divmod(np.unique(keys), n_terms)

    def retrieve(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the items' thresholds; a score of 1 is the threshold."""
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not len(term):
            return none
        bound = 1 - ROUNDING
        # The pivot: terms are numbered by falling frequency.
        sums = np.cumsum(self.most[term])
        new = np.concatenate([[True], passage[1:] != passage[:-1]])
        own = sums - (sums - self.most[term])[np.maximum.accumulate(np.where(new, np.arange(len(term)), 0))]
        essential = own >= bound
        if not essential.any():
            return none
        rest = np.zeros(passage[-1] + 1)
        np.maximum.at(rest, passage[~essential], own[~essential])
        owner, at = _expand(self.block_starts, term[essential])
        block, most = _sums(passage[essential][owner] * self.n_blocks + self.blocks[at], self.block_most[at])
        go = most + rest[block // self.n_blocks] >= bound
        block, most = block[go], most[go]
        # The other terms' block maxima, for passages that are left.
        left = np.zeros(len(rest), bool)
        left[block // self.n_blocks] = True
        other = ~essential & left[passage]
        owner, at = _expand(self.block_starts, term[other])
        keys, more = self._within(block, passage[other][owner] * self.n_blocks + self.blocks[at], self.block_most[at])
        np.add.at(most, keys, more)
        block = block[most >= bound]
        # Items of the blocks that are left.
        left[:] = False
        left[block // self.n_blocks] = True
        use = left[passage]
        owner, at = _expand(self.starts, term[use])
        p, item, value = passage[use][owner], self.items[at], self.values[at]
        inside = self._inside(block, p * self.n_blocks + item // BLOCK)
        pairs, score = _sums(p[inside] * len(self.ids) + item[inside], value[inside])
        found = score >= bound
        return *np.divmod(pairs[found], len(self.ids)), score[found]

    @staticmethod
    def _inside(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Whether keys are among the sorted names."""
        if not len(names):
            return np.zeros(len(keys), bool)
        return names[np.minimum(np.searchsorted(names, keys), len(names) - 1)] == keys

    def _within(self, names: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self._inside(names, keys)
        return np.searchsorted(names, keys[inside]), values[inside]

    def search(self, words: np.ndarray, begin: np.ndarray):
        """(text, item_id, bm25, question_overlap, answer_overlap, first_word, n_passages, item_overlap) of each leak."""
        first, passage, term = self.passages(words, begin)
        best: dict[tuple[int, int], tuple] = {}
        n: dict[tuple[int, int], int] = defaultdict(int)
        for p, k, score in zip(*(x.tolist() for x in self.retrieve(passage, term)), strict=True):
            text = int(np.searchsorted(first, p, "right")) - 1
            at = (p - int(first[text])) * self.step
            part = words[begin[text] + at : min(begin[text] + at + 2 * self.step, begin[text + 1])].tolist()
            own = shingles(part) if len(part) >= SHINGLE else {tuple(part)}
            question, answer, both = self._parts(k)
            share = [self._share(x, own, part) for x in (question, answer)]
            whole = self._share(both, own, part) if both else None
            if min(share) >= OVERLAP or (whole or 0.0) >= OVERLAP:
                n[text, k] += 1
                found = (round(score * self.threshold[k], 9), round(share[0], 9), round(share[1], 9), -at, whole)
                best[text, k] = max(best.get((text, k), (0.0,)), found)
        for (text, k), x in best.items():
            yield text, self.ids[k], *x[:3], -x[3], n[text, k], x[4]

    @staticmethod
    def _share(wanted: set, own: set, part: list) -> float:
        if not wanted:
            return 1.0
        size = len(next(iter(wanted)))
        return len(wanted & (own if size == SHINGLE else shingles(part, size))) / len(wanted)


class Index:
    """The indexes of all classes of some items: lists of (item_id, question words, answer words,
    whether the answer was cut off)."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes], bool]], df: dict[bytes, int], n_items: int, mean_words: float) -> None:
        vocabulary = sorted({w for _, q, a, _ in items for w in q + a}, key=lambda w: (-df[w], w))
        self.numbers = {w: k for k, w in enumerate(vocabulary)} | {_PART: PART}
        frequency = np.array([df[w] for w in vocabulary], float)
        idf = np.log(1 + (n_items - frequency + 0.5) / (frequency + 0.5))
        classes: dict[int, list] = defaultdict(list)
        for i, q, a, cut_off in items:
            numbers = [np.fromiter(map(self.numbers.__getitem__, x), np.int32, len(x)) for x in (q, a)]
            terms, c = np.unique(np.concatenate(numbers), return_counts=True)
            norm = K1 * (1 - B + B * len(q + a) / mean_words)
            passage = PASSAGE_WORDS << max(0, math.ceil(math.log2(2 * len(q + a) / PASSAGE_WORDS)))
            classes[passage].append(((i, *numbers, cut_off), (terms, idf[terms] * c * (K1 + 1) / (c + norm))))
        self.classes = [Class(passage, *map(list, zip(*own, strict=True)), len(vocabulary)) for passage, own in sorted(classes.items())]

    def numbers_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts joined, and where each text's words start, and the end."""
        data = (b" " + _PART + b" ").join(t.translate(_FOLD) for t in texts)
        number, parts = self.numbers.get, []
        for piece in pieces(data, PIECE_BYTES):
            words = piece.split()
            parts.append(np.fromiter(map(number, words, repeat(UNKNOWN)), np.int32, len(words)))
        words = np.concatenate(parts)
        edges = np.nonzero(words == PART)[0]
        return words[words != PART].astype(np.int64), np.concatenate([[0], edges - np.arange(len(edges)), [len(words) - len(edges)]])

    def search(self, texts: list[bytes]):
        words, begin = self.numbers_of(texts)
        for own in self.classes:
            yield from own.search(words, begin)


def _split_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, question, answer) with texts as binary; answer null where it is to be cut off."""
    cast = lambda c: F.col(c).cast("binary")
    if {"question", "answer"} <= set(benchmark.columns):
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), cast("question").alias("question"), cast("answer").alias("answer"))
    else:
        rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), cast("text").alias("question"), F.lit(None).cast("binary").alias("answer"))
    return rows.dropDuplicates()


def _question_answer(question: bytes | None, answer: bytes | None) -> tuple[list[bytes], list[bytes]]:
    q = words_of(question)
    if answer is not None:
        return q, words_of(answer)
    n = max(SHINGLE, len(q) // 5)
    return (q[:-n], q[-n:]) if len(q) >= 2 * SHINGLE else (q, [])


def _term_counts(batches):
    for pdf in batches:
        counts: dict[bytes, int] = defaultdict(int)
        n = length = 0
        for q, a in zip(pdf["question"], pdf["answer"], strict=True):
            words = [w for part in _question_answer(q, a) for w in part]
            n, length = n + bool(words), length + len(words)
            for w in set(words):
                counts[w] += 1
        yield pd.DataFrame([(w, c, 0, 0) for w, c in counts.items()] + [(None, 0, n, length)], columns=["term", "df", "n", "words"])


def leaks(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Leaks of benchmark(item_id, text) in docs(doc_id, text), one row per document and item."""
    spark = docs.sparkSession
    items = _split_items(benchmark)
    length = F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))
    total, longest = items.agg(F.sum(length), F.max(length)).first()
    n_shards = max(1, math.ceil((total or 0) / shard_bytes))
    terms = items.mapInPandas(_term_counts, "term binary, df long, n long, words long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "n", "words")))
    n_items, n_words = terms.where("term IS NULL").select("n", "words").first() or (0, 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = spark.createDataFrame([], LEAKS)
    for shard in range(n_shards if n_items else 0):
        own = items.where(F.pmod(F.xxhash64("item_id", "question"), F.lit(n_shards)) == shard)
        texts = [(r["item_id"], *_question_answer(r["question"], r["answer"]), r["answer"] is None) for r in own.collect()]  # at most about shard_bytes
        texts = sorted(x for x in texts if x[1] or x[2])
        if not texts:
            continue
        vocabulary = sorted({w for _, q, a, _ in texts for w in q + a})
        wanted = terms if n_shards == 1 else terms.join(spark.createDataFrame([(bytearray(w),) for w in vocabulary], "term binary"), "term", "left_semi")
        df = {bytes(r["term"]): r["df"] for r in wanted.where("term IS NOT NULL").select("term", "df").collect()}
        index = spark.sparkContext.broadcast(Index(texts, df, n_items, n_words / n_items))
        found = rows.mapInArrow(_search(index), LEAKS)
        out = found if shard == 0 else out.union(found)
    return out


def _slices(texts):
    """Row ranges of about SLICE_BYTES of text."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size > SLICE_BYTES:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _search(index):
    names = [x.split()[0] for x in LEAKS.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in LEAKS.split(", ")]

    def search(batches):
        own = index.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                hits = [(ids[a + text], *hit) for text, *hit in own.search([t or b"" for t in texts[a:b]])]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits, strict=True), kinds, strict=True)], names=names)

    return search
