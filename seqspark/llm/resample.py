"""Importance resampling towards a target: documents drawn by the likelihood ratio of hashed word n-grams.

Features of a text are all runs of 1 to ORDERS consecutive words, repeats counted; a feature's bucket is the
CRC-32 of its bytes modulo BUCKETS. A bucket's gain is the logarithm of its share in the target over its share
in the documents; a document's weight is the mean gain of its features, and Gumbel noise from a hash of its
id turns the highest scores into a sample without replacement.

CRCs are worked out in length-bucketed matrices: the distinct features of some texts are slices of one buffer
of words with single blanks; slices of equal length become the rows of a uint8 matrix, all CRCs of a matrix
advance column by column, and the buckets are scattered back to the features and from there to the texts.
Features beyond LONG bytes, for which a matrix would be a few rows of very many columns, take the same CRC one
by one.

Texts are read once: the buckets of each document's features, two or so bytes each, are a written table, of which
the counts of buckets (at most BUCKETS rows a task, summed map-side) and the weights are short passes. What the
workers get in between is one number a bucket, whatever the input. The order of the drawn documents comes
from ranges of scores that are counted one by one, so no task holds them all.

Defined results for odd rows: a null or blank text has no words, no features and weight 0; a null doc_id is
hashed as the word null and comes last among equal scores; rows with equal id and score are told apart by
a hash of the text, then by their place in the files; repeated rows are drawn one by one; an empty target has
equal shares for all buckets; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut, drop, numbered
from seqspark.llm.words import SLICE_BYTES, Words, slices

ORDERS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 2, 10_000, 7, 20, 25
#: Bytes of a CRC matrix, and of a feature that gets no matrix; texts that are taken at once, at most.
MATRIX_BYTES, LONG, ROWS = 4 << 20, 256, 1 << 15


def _crc_table() -> np.ndarray:
    """CRC-32 of every single byte value, by the reflected polynomial EDB88320."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (value & np.uint32(1)))
    return value


_TABLE = _crc_table()


def crc32_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional uint8 array, all rows advancing column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_slices(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of a uint8 buffer that begin at starts and have the sizes (1 at least)."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    edges = np.concatenate([[0], np.nonzero(np.diff(sizes[order]))[0] + 1, [len(order)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a == b:
            continue
        size = int(sizes[order[a]])
        if size > LONG:
            for i in order[a:b].tolist():
                out[i] = zlib.crc32(buffer[starts[i] : starts[i] + size])
            continue
        windows = np.lib.stride_tricks.sliding_window_view(buffer, size)
        step = max(1, MATRIX_BYTES // size)
        for at in range(a, b, step):
            rows = order[at : min(at + step, b)]
            out[rows] = crc32_rows(windows[starts[rows]])
    return out


def features(words: Words, orders: int = ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of some words."""
    ids, n_ids = words.numbers()
    texts, found = [], []
    code = ids
    for n in range(1, orders + 1):
        last = len(words) - n + 1
        if last <= 0:
            break
        if n > 1:
            # The code of a run is that of the run without its last word, told apart among those seen, and that word.
            code = (code[:last] if n == 2 else np.unique(code[:last], return_inverse=True)[1]) * n_ids + ids[n - 1 :]
        use = np.nonzero((words.text[:last] == words.text[n - 1 :]) & words.new[n - 1 :])[0]
        _, first, slot = np.unique(code[use], return_index=True, return_inverse=True)
        at = use[first]
        end = words.starts[at + n - 1] + words.sizes[at + n - 1]
        own = crc32_slices(words.buffer, words.starts[at], end - words.starts[at]) % np.uint32(buckets)
        texts.append(words.text[use])
        found.append(own[slot].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (texts, found))


FEATURES = "doc_id long, tie long, n_words long, buckets array<int>"
WEIGHTS = "doc_id long, tie long, n_words long, n_features long, weight long"
_names = lambda schema: [x.split()[0] for x in schema.split(", ")]


def with_features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text) as FEATURES: the bucket of each feature, in no order; tie is a hash of the text."""

    def hash_(batches):
        for batch in batches:
            for a, b in _rows(batch):
                n_words = np.zeros(b - a, np.int64)
                parts = []
                for words in slices(batch.column(2).slice(a, b - a).to_pylist(), orders - 1):
                    n_words += np.bincount(words.text[words.new], minlength=b - a)
                    parts.append(features(words, orders, buckets))
                text, bucket = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
                order = np.argsort(text.astype(np.uint16), kind="stable")  # at most ROWS texts
                edges = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(bucket[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n_words), lists], names=_names(FEATURES))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(hash_, FEATURES)


def _rows(batch: pa.RecordBatch):
    """Ranges of rows with about 4 SLICE_BYTES of text, ROWS at most."""
    at = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(2)).to_pylist()):
        size += n or 0
        if size >= 4 * SLICE_BYTES or i + 1 - at == ROWS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(batch):
        yield at, len(batch)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """(edges, values) of a list column without nulls."""
    edges = np.asarray(column.offsets)
    return edges - edges[0], np.asarray(column.values)[edges[0] : edges[-1]]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows(buckets) by bucket; at most `buckets` rows a task are shuffled."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_lists(batch.column(0))[1], minlength=buckets)
        seen = np.nonzero(total)[0]
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own_rows: DataFrame, target_rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the documents, one added to every bucket."""
    own, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((own, own_rows), (wanted, target_rows)):
        for r in bucket_counts(rows, buckets).collect():  # `buckets` rows at most
            counts[r["bucket"]] = r["n"]
    s_all, t_all = float(own.sum() + buckets), float(wanted.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(own.tolist(), wanted.tolist(), strict=True)], dtype=np.int64)


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """FEATURES as WEIGHTS: the floored mean of the gains of a row's features."""

    def weigh(batches):
        for batch in batches:
            edges, bucket = _lists(batch.column(3))
            n = np.diff(edges).astype(np.int64)
            some = np.nonzero(n)[0]
            total = np.zeros(len(n), np.int64)
            if len(some):
                total[some] = np.add.reduceat(gain[bucket], edges[:-1][some])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), pa.array(total // np.maximum(n, 1))], names=_names(WEIGHTS))  # floors go down

    return rows.mapInArrow(weigh, WEIGHTS)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 times Gumbel noise) from the first 32 bits of SHA-256 of seed:id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): rank from 1 on for the drawn percent of the documents of
    least_words words or more, null for the others."""
    hashed = cut(with_features(docs), "features")
    rows = weights(hashed, gains(hashed, with_features(target.withColumn("doc_id", F.lit(0)))))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows, "weights")
    drop(hashed)
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    keys = {"__unable": ~able, "__fall": -F.col("score"), "__none": F.col("doc_id").isNull()}
    placed = numbered(rows.withColumns(keys), ["__unable", "__fall", "__none", "doc_id", "tie", "row"])
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
