"""Ranked lexical search: bit-sliced Bloom signatures bound every document's score, the rest is scored exactly.

The index. Documents of similar length form blocks; every document sets the bits of a Bloom filter for each of
its (term, level): level l stands for 2**l occurrences or more. The filters of a block's documents are cut into
slices: slice b is a bitmap with bit b of all the block's documents. Filters are as wide as the longest of a
block needs, a power of two with BITS bits a key at least. An index row is a block: ids, keys, lengths,
largest occurrence counts, slices. The index holds the document frequencies of all terms as well, by two 64-bit hashes of a term.

The search. For an item's term and a level, the bitmaps of the term's slices are joined by AND: a set bit is a
document that may hold the term so often, a bit not set one that does not. So the highest level of a document
bounds a term's occurrences, and the weighted sum of the levels' impacts is an upper bound of the document's
score. (1) Of each item, the TOP documents with the highest bounds are scored exactly; the lowest of these
scores is the item's threshold. (2) Every document whose bound reaches the threshold is scored exactly from its
whole text (where bound and threshold are equal, a larger id excludes too). All others are provably worse than
TOP documents, so the ranking is exact.

Items are taken in shards of SHARD_BYTES of their terms, which bounds what the workers get; each shard is a
further pass over the index. Candidates are found again by a hash of id and text: they are broadcast up to
BROADCAST_ROWS of them, beyond that joined by a shuffle.

Defined results for odd rows: a null or blank text has no term and is no document; an item that is null or
holds no term of any document gets no rows; repeated rows of documents are ranked one by one, of items once;
items that share an id and differ in text are ranked for themselves; a document with a null id comes last among
equal scores; rows with equal score and id take any order; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import cut
from seqspark.llm.token_parquet import pieces
from seqspark.llm.words import FOLD, slices

TOP = 10
#: Bits of a filter for each key, hash functions, levels of occurrence counts.
BITS, HASHES, LEVELS = 10, 3, 7
#: Bits of a block's slices, about, and its documents at most; terms of documents that a task counts up before it lets them go.
BLOCK_BITS, BLOCK_ROWS, TERMS_KEPT = 1 << 22, 2048, 1 << 20
SHARD_BYTES, BROADCAST_ROWS, PIECE_BYTES = 16 << 20, 200_000, 1 << 20
#: Numbers of (term, document) that are held at once while bounds are added up.
CELLS = 1 << 21
#: Bytes of an item's term beside its text in a worker.
TERM_BYTES = 200

BLOCK = "ids array<long>, keys array<long>, sizes array<long>, most array<long>, width int, slices binary"
INDEX = f"{BLOCK}, h long, g long, df long"
_TYPES = [pa.list_(pa.int64())] * 4 + [pa.int32(), pa.binary()] + [pa.int64()] * 3
_NAMES = ["ids", "keys", "sizes", "most", "width", "slices", "h", "g", "df"]


def term_counts(text: bytes | None) -> Counter:
    counts: Counter = Counter()
    for piece in pieces((text or b"").translate(FOLD), PIECE_BYTES):
        counts.update(piece.split())
    return counts


def level_keys(h: np.ndarray, g: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """One 64-bit key for each term and level that it reaches."""
    keys = [h]
    for level in range(1, LEVELS):
        more = np.nonzero(tf >= 1 << level)[0]
        if not len(more):
            break
        keys.append(level_key(h[more], g[more], level))
    return np.concatenate(keys)


def level_key(h: np.ndarray, g: np.ndarray, level: int) -> np.ndarray:
    return h + np.uint64(level) * (g | np.uint64(1))


def slice_numbers(keys: np.ndarray, width: int):
    """The HASHES slices of each key, an array for each hash; width is a power of two."""
    step, mask = (keys >> np.uint64(32)) | np.uint64(1), np.uint64(width - 1)
    for k in range(HASHES):
        yield ((keys + np.uint64(k) * step) & mask).view(np.int64)


class Block:
    """Documents of one filter width, collected until they fill a block."""

    def __init__(self, width: int) -> None:
        self.width, self.rows = width, min(BLOCK_ROWS, max(8, BLOCK_BITS // width))
        self.start()

    def start(self) -> None:
        self.bits = np.zeros((self.rows, self.width), bool)
        self.docs: list[tuple] = []

    def add(self, doc: tuple, keys: np.ndarray) -> bool:
        own = self.bits[len(self.docs)]
        for numbers in slice_numbers(keys, self.width):
            own[numbers] = True
        self.docs.append(doc)
        return len(self.docs) == self.rows

    def row(self) -> tuple:
        slices = np.packbits(self.bits[: len(self.docs)].T, axis=1)
        out = (*map(list, zip(*self.docs, strict=True)), self.width, slices.tobytes(), None, None, None)
        self.start()
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


class Frequencies:
    """Documents that hold each term, summed up in the task."""

    def __init__(self) -> None:
        self.h, self.g, self.held = [], [], 0

    def add(self, h: np.ndarray, g: np.ndarray) -> bool:
        self.h.append(h)
        self.g.append(g)
        self.held += len(h)
        return self.held > TERMS_KEPT

    def batch(self) -> pa.RecordBatch:
        h, g = np.concatenate(self.h), np.concatenate(self.g)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.nonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))[0]
        df = np.diff(np.append(new, len(h)))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.nulls(len(new), t) for t in _TYPES[:6]] + [pa.array(x) for x in (h[new].view(np.int64), g[new].view(np.int64), df)], names=_NAMES)


def _documents(ids: list, keys: list, texts: list):
    """(id, key, h, g, tf) of every text with a term: its distinct terms by hash, and how often they occur."""
    held: dict[int, list] = defaultdict(list)
    at = 0
    for words in slices(texts):
        h, g = words.hashes()
        edges = [*np.searchsorted(words.text, np.unique(words.text)).tolist(), len(words)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = int(words.text[a])
            while at < i:  # the texts before are complete
                if at in held:
                    yield ids[at], keys[at], *_together(held.pop(at))
                at += 1
            names, first, tf = np.unique(h[a:b], return_index=True, return_counts=True)
            held[i].append((names, g[a:b][first], tf))
    for i in sorted(held):
        yield ids[i], keys[i], *_together(held[i])


def _together(parts: list[tuple]) -> tuple:
    if len(parts) == 1:
        return parts[0]
    h, g, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, first, slot = np.unique(h, return_index=True, return_inverse=True)
    return names, g[first], np.bincount(slot, tf).astype(np.int64)


def _index(batches):
    blocks: dict[int, Block] = {}
    counts = Frequencies()
    for batch in batches:
        for i, key, h, g, tf in _documents(*(c.to_pylist() for c in batch.columns)):
            own = level_keys(h, g, tf)
            width = 1 << max(6, (len(own) * BITS - 1).bit_length())
            if width not in blocks:
                blocks[width] = Block(width)
            if blocks[width].add((i, key, int(tf.sum()), int(tf.max())), own):
                yield _batch([blocks[width].row()])
            if counts.add(h, g):
                yield counts.batch()
    for block in blocks.values():
        if block.docs:
            yield _batch([block.row()])
    if counts.held:
        yield counts.batch()


def key() -> Column:
    """Names a document's row, the same for rows that are equal in id and text."""
    return F.xxhash64("doc_id", "text")


class Index:
    """The written index of docs(doc_id, text): blocks, terms(h, g, df) by their two hashes, the number of documents and of their terms."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
        rows = cut(self.docs.select("doc_id", key().alias("key"), "text").mapInArrow(_index, INDEX), "signatures")
        self.blocks = rows.where("h IS NULL").select(*_NAMES[:6])
        self.terms = cut(rows.where("h IS NOT NULL").groupBy("h", "g").agg(F.sum("df").alias("df")), "terms")
        total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
        self.n, self.length = (x or 0 for x in self.blocks.agg(F.sum(F.size("sizes")), F.sum(total)).first())

    def candidates(self, queries, least=None) -> DataFrame:
        """(item, key, doc_id, bound): without least the documents with the highest bounds of each task, TOP of each
        item; with least (item -> score and id to be reached) all that may reach it. queries, least: broadcasts."""
        n, length = self.n, self.length

        def search(batches):
            own = queries.value
            if least is None:
                best = _Best(len(own.items))
            for batch in batches:
                for row in batch.to_pylist():
                    block = _Read(row, n, length)
                    for first, bounds in own.bounds(block):
                        if least is None:
                            best.add(first, bounds, block)
                        else:
                            yield from _reached(first, bounds, block, least.value)
            if least is None:
                yield from best.batches()

        return self.blocks.mapInArrow(search, CANDIDATE)

    def score(self, wanted: DataFrame, queries) -> DataFrame:
        """Exact scores (item, doc_id, score) above 0 of wanted(item, key); queries: a broadcast."""
        n, length = self.n, self.length
        wanted = cut(wanted.groupBy("key").agg(F.collect_set("item").alias("items")), "wanted")
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        rows = self.docs.withColumn("key", key()).join(wanted, "key").select("doc_id", "text", "items")

        def exact(batches):
            own = queries.value
            for pdf in batches:
                out = []
                for i, text, items in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["items"], strict=True):
                    out += [(item, None if pd.isna(i) else int(i), s) for item, s in own.scores(term_counts(text), items, n, length)]
                yield pd.DataFrame({"item": pd.Series([x[0] for x in out], dtype="int64"), "doc_id": pd.Series([x[1] for x in out], dtype="Int64"), "score": pd.Series([x[2] for x in out], dtype="int64")})

        return rows.mapInPandas(exact, "item long, doc_id long, score long")


CANDIDATE = "item long, key long, doc_id long, bound long"
_CANDIDATE_TYPES = [pa.int64()] * 4


class _Read:
    """A block as it is read: bounds of impacts by level for its documents."""

    def __init__(self, row: dict, n: int, length: int) -> None:
        self.ids, self.keys = row["ids"], np.array(row["keys"], np.int64)
        self.width, self.count = row["width"], len(row["keys"])
        self.slices = np.frombuffer(row["slices"], np.uint8).reshape(self.width, -1)
        m, most = norm(np.array(row["sizes"], np.int64), n, length), np.array(row["most"], np.int64)
        tops = [np.minimum(most, (2 << level) - 1) for level in range(LEVELS - 1)] + [most]
        self.impacts = [impact(tf, m) for tf in tops]


def norm(size, n: int, length: int):
    return 100 - 90 + (90 * size * n) // length


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Queries:
    """Items as sparse rows over their vocabulary: terms' hashes and weights."""

    def __init__(self, items: dict[int, dict[bytes, int]]) -> None:
        self.items = items  # item -> term -> weight
        self.vocabulary = sorted({t for own in items.values() for t in own})
        number = dict(zip(self.vocabulary, range(len(self.vocabulary))))
        self.h, self.g = (np.concatenate(x) for x in zip(*(w.hashes() for w in slices([b" ".join(self.vocabulary)])), strict=True))
        self.starts = np.cumsum([0, *(len(own) for own in items.values())])
        self.term = np.array([number[t] for own in items.values() for t in own], np.int64)
        self.weight = np.array([w for own in items.values() for w in own.values()], np.int64)

    def bounds(self, block: _Read):
        """(first item, array of items x documents) of upper bounds, some items at a time."""
        here, levels = np.arange(len(self.vocabulary)), []
        for level in range(LEVELS):
            own = level_key(self.h[here], self.g[here], level)
            bits = np.bitwise_and.reduce([block.slices[numbers] for numbers in slice_numbers(own, block.width)])
            if level:
                bits &= levels[-1][1][np.searchsorted(levels[-1][0], here)]
            some = bits.any(axis=1)
            here, bits = here[some], bits[some]
            if not len(here):
                break
            levels.append((here, bits))
        if not levels:
            return
        # Terms that the block may hold, and items cut to those.
        present = levels[0][0]
        place = np.full(len(self.vocabulary), -1)
        place[present] = np.arange(len(present))
        use = np.nonzero(place[self.term] >= 0)[0]
        owner = np.searchsorted(self.starts, use, "right") - 1
        rows = max(8, CELLS // max(1, len(present)) // 8 * 8)  # documents at once
        items, begin = np.unique(owner, return_index=True)
        for a in range(0, block.count, rows):
            b = min(a + rows, block.count)
            table = np.zeros((len(present), b - a), np.int64)
            for (at, bits), gain in zip(levels, block.impacts):
                on = np.unpackbits(bits[:, a // 8 : (b + 7) // 8], axis=1, count=b - a).astype(bool)
                where = place[at]
                table[where] = np.where(on, gain[a:b], table[where])
            step = max(1, CELLS // (b - a))  # entries of items at once
            for p, q in _runs(begin, len(use), step):
                x, y = begin[p], begin[q] if q < len(begin) else len(use)
                sums = np.add.reduceat(table[place[self.term[use[x:y]]]] * self.weight[use[x:y], None], begin[p:q] - x, axis=0)
                yield (items[p:q], a), sums

    def scores(self, counts: Counter, items, n: int, length: int):
        """(item, score) above 0 of one text."""
        m = norm(sum(counts.values()), n, length) if counts else 0
        for item in items:
            score = sum(w * impact(tf, m) for t, w in self.items[int(item)].items() if (tf := counts.get(t, 0)))
            if score > 0:
                yield int(item), score


def _runs(begin: np.ndarray, end: int, step: int):
    """Ranges (p, q) of items with about `step` entries together."""
    p = 0
    edges = np.append(begin, end)
    while p < len(begin):
        q = max(p + 1, int(np.searchsorted(edges, edges[p] + step, "right")) - 1)
        yield p, q
        p = q


class _Best:
    """The TOP highest bounds of each item so far."""

    def __init__(self, n: int) -> None:
        self.bound, self.key, self.id = (np.zeros((n, TOP), np.int64) for _ in range(3))
        self.none = np.zeros((n, TOP), bool)

    def add(self, at: tuple[np.ndarray, int], sums: np.ndarray, block: _Read) -> None:
        items, a = at
        k = min(TOP, sums.shape[1])
        top = np.argpartition(-sums, k - 1, axis=1)[:, :k]
        new = np.take_along_axis(sums, top, axis=1)
        go = np.nonzero(new.max(axis=1) > self.bound[items].min(axis=1))[0]
        if not len(go):
            return
        items, top, new = items[go], top[go] + a, new[go]
        both = np.concatenate([self.bound[items], new], axis=1)
        keys = np.concatenate([self.key[items], block.keys[top]], axis=1)
        ids = np.array([-1 if i is None else i for i in block.ids], np.int64)
        none = np.array([i is None for i in block.ids], bool)
        pick = np.argsort(-both, axis=1, kind="stable")[:, :TOP]
        own = lambda old, new: np.take_along_axis(np.concatenate([old, new], axis=1), pick, axis=1)
        self.id[items], self.none[items] = own(self.id[items], ids[top]), own(self.none[items], none[top])
        self.bound[items], self.key[items] = np.take_along_axis(both, pick, axis=1), np.take_along_axis(keys, pick, axis=1)

    def batches(self):
        item, k = np.nonzero(self.bound)
        if len(item):
            yield _candidates(item, self.key[item, k], self.id[item, k], self.none[item, k], self.bound[item, k])


def _candidates(item, keys, ids, none, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(keys), pa.array(ids, mask=none), pa.array(bound)], names=[x.split()[0] for x in CANDIDATE.split(", ")])


def _reached(at: tuple[np.ndarray, int], sums: np.ndarray, block: _Read, least: dict[str, np.ndarray]):
    """The candidates among some bounds: above the item's threshold, or equal with an id that may win the tie."""
    items, a = at
    score, last = least["score"][items], least["id"][items]
    keep = sums >= score[:, None]
    if not keep.any():
        return
    i, d = np.nonzero(keep)
    ids = np.array([-1 if x is None else x for x in block.ids], np.int64)
    none = np.array([x is None for x in block.ids], bool)
    at = d + a
    bound = sums[i, d]
    fine = (bound > score[i]) | least["open"][items[i]] | (~none[at] & (ids[at] <= last[i]))
    i, at, bound = i[fine], at[fine], bound[fine]
    if len(i):
        yield _candidates(items[i], block.keys[at], ids[at], none[at], bound)


def _item_terms(batches):
    for pdf in batches:
        for item, text in zip(pdf["item"], pdf["text"], strict=True):
            terms = list(term_counts(text))
            if terms:
                h, g = (np.concatenate(x).view(np.int64) for x in zip(*(w.hashes() for w in slices([b" ".join(terms)])), strict=True))
                yield pd.DataFrame({"item": item, "term": terms, "h": h, "g": g})


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    own = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    return scores.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The TOP documents of docs(doc_id, text) for each of items(item_id, text): (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    index = Index(docs)
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not index.n:
        return empty
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct()
    rows = cut(rows.withColumn("item", F.monotonically_increasing_id()), "items")
    terms = rows.select("item", "text").mapInPandas(_item_terms, "item long, term binary, h long, g long").join(index.terms, ["h", "g"])
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.n + 2) / (2 * F.col("df") + 1)))
    terms = cut(terms.select("item", "term", weight.cast("long").alias("weight")), "weights")
    size = terms.agg(F.sum(F.octet_length("term") + TERM_BYTES)).first()[0] or 0
    n_shards = max(1, math.ceil(size / shard_bytes))
    out = empty
    for shard in range(n_shards):
        found: dict[int, dict[bytes, int]] = defaultdict(dict)
        own = terms if n_shards == 1 else terms.where(F.pmod(F.xxhash64("item"), F.lit(n_shards)) == shard)
        for r in own.orderBy("item", "term").collect():  # about shard_bytes
            found[r["item"]][bytes(r["term"])] = r["weight"]
        if not found:
            continue
        names = list(found)
        queries = spark.sparkContext.broadcast(Queries(dict(enumerate(found.values()))))
        seeds = _ranked(index.candidates(queries).withColumnRenamed("bound", "score"), TOP)
        scores = _ranked(index.score(seeds.select("item", "key"), queries), TOP).where(F.col("rank") == TOP).collect()  # one row an item
        least = {"score": np.ones(len(names), np.int64), "id": np.zeros(len(names), np.int64), "open": np.ones(len(names), bool)}
        for r in scores:
            least["score"][r["item"]] = r["score"]
            if r["doc_id"] is not None:
                least["id"][r["item"]], least["open"][r["item"]] = r["doc_id"], False
        wanted = cut(index.candidates(queries, spark.sparkContext.broadcast(least)).select("item", "key"), "candidates")
        ranked = _ranked(index.score(wanted, queries), TOP)
        numbers = spark.createDataFrame(list(enumerate(names)), "number long, item long")  # the shard's items
        ranked = ranked.withColumnRenamed("item", "number").join(numbers, "number").join(rows.select("item", "item_id"), "item")
        out = out.union(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
