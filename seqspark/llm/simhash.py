"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Fingerprints that differ in at most RADIUS bits are linked. Equal fingerprints are collapsed
first. Two fingerprints within RADIUS bits agree on at least one of RADIUS + 1 blocks of bits, so
tiles are drawn inside each block's values only; a value with more than TILE fingerprints is cut
into tiles of one bit count each. Tile pairs whose bit counts differ by more than RADIUS are
skipped; all others are compared whole with exclusive-or and bit counts in numpy. No pair within
RADIUS bits is lost.

Defined results for odd rows: a null or blank text has fingerprint zero and is linked like any
other; repeated rows are separate rows of one group; a row with a null doc_id gets the component
of its fingerprint (null if no row there has an id); other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import components, cut
from seqspark.llm.token_parquet import pieces

WORDS, SEED, RADIUS, TILE = 3, 42, 2, 4096


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of UTF-8 text."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    tail: list[bytes] = []
    ones, n = np.zeros(64, np.int64), 0
    for piece in pieces((text or b"").lower()):
        tail += piece.split()
        if len(tail) < words:
            continue
        hashes = np.array([digest(join(x), SEED) for x in zip(*(tail[i:] for i in range(words)))], dtype="<u8")
        tail = tail[1 - words :] if words > 1 else []
        for at in range(0, len(hashes), 1 << 15):
            part = hashes[at : at + (1 << 15)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    if not n:
        return digest(join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def of_hashes(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of 64-bit shingle hashes, each counted as often as it is there; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def apart(a, b):
    """Bits in which two fingerprint columns differ."""
    return F.bit_count(a.bitwiseXOR(b))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, fp), fp the fingerprint as a signed long."""

    def compute(batches):
        for pdf in batches:
            fps = np.array([fingerprint(x, words) for x in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(compute, "doc_id long, fp long")


def close_pairs(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = 512):
    """Index arrays (i, j) of left[i], right[j] within radius bits; right None: pairs i < j of left.

    Both sides are put in order of bit count and cut into tiles; tile pairs whose bit counts are
    further apart than radius are skipped.
    """
    own = right is None
    a_order = np.argsort(np.bitwise_count(left), kind="stable")
    b_order = a_order if own else np.argsort(np.bitwise_count(right), kind="stable")
    a, b = left[a_order], left[a_order] if own else right[b_order]
    a_bits, b_bits = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    found = [(np.empty(0, int), np.empty(0, int))]
    for i in range(0, len(a), tile):
        x = a[i : i + tile, None]
        for j in range(i if own else 0, len(b), tile):
            if b_bits[j] - a_bits[min(i + tile, len(a)) - 1] > radius:
                break
            if a_bits[i] - b_bits[min(j + tile, len(b)) - 1] > radius:
                continue
            near = np.bitwise_count(x ^ b[None, j : j + tile]) <= radius
            if own and i == j:
                near = np.triu(near, 1)
            p, q = np.nonzero(near)
            found.append((a_order[p + i], b_order[q + j]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _compare(batches):
    """Rows (left, right) of tiles, right null for a tile against itself, as links between ids."""
    for pdf in batches:
        out = []
        for left, right in zip(pdf["left"], pdf["right"], strict=True):
            ids, fps = (np.array([x[k] for x in left], dtype=np.int64) for k in ("rep", "fp"))
            if right is None:
                i, j = close_pairs(fps.view(np.uint64), None)
                out.append((ids[i], ids[j]))
            else:
                other, more = (np.array([x[k] for x in right], dtype=np.int64) for k in ("rep", "fp"))
                i, j = close_pairs(fps.view(np.uint64), more.view(np.uint64))
                out.append((ids[i], other[j]))
        if out:
            yield pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([x for _, x in out])})


def links(reps: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between reps(fp, rep) whose fingerprints lie within RADIUS bits; a link may
    come from more than one block."""
    edges = np.linspace(0, 64, RADIUS + 2).astype(int)
    blocks = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", int(lo)).bitwiseAND((1 << int(hi - lo)) - 1).alias("value")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    rows = reps.where("rep IS NOT NULL").select("fp", "rep", F.explode(F.array(*blocks)).alias("at")).select("at.*", "fp", "rep")
    large = cut(rows.groupBy("block", "value").count().where(F.col("count") > tile), "large")
    rows = cut(rows.join(large, ["block", "value"], "left"), "blocks")
    item = F.struct("rep", "fp")

    small = rows.where("count IS NULL").groupBy("block", "value").agg(F.collect_list(item).alias("left")).where(F.size("left") > 1)
    small = small.select("left", F.lit(None).cast("array<struct<rep:bigint,fp:bigint>>").alias("right"))

    # A large value: tiles (bits, slot); every fingerprint goes to each pair of tiles that its own is in.
    big = rows.where("count IS NOT NULL").select(
        "block", "value", "fp", "rep", F.bit_count("fp").alias("bits"), F.ceil(F.col("count") / tile).cast("int").alias("slots")
    )
    big = big.select("*", F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int").alias("slot"))
    own = F.struct(F.col("bits").alias("bits"), F.col("slot").alias("slot"))
    others = F.flatten(
        F.transform(
            F.sequence(F.col("bits") - RADIUS, F.col("bits") + RADIUS),
            lambda b: F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda s: F.struct(b.alias("bits"), s.alias("slot"))),
        )
    )
    big = big.select("block", "value", "fp", "rep", own.alias("own"), F.explode(others).alias("other"))
    pair = big.groupBy("block", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(
        F.collect_list(F.when(F.col("own") <= F.col("other"), item)).alias("left"), F.collect_list(F.when(F.col("own") > F.col("other"), item)).alias("right")
    )
    pair = pair.where("x = y OR (size(left) > 0 AND size(right) > 0)").select("left", F.when(F.col("x") != F.col("y"), F.col("right")).alias("right"))
    return small.union(pair).mapInPandas(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, fingerprint, component_id)."""
    rows = cut(fingerprints(docs), "fingerprints")
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = components(links(reps)).withColumnRenamed("node", "rep")
    groups = cut(reps.join(roots, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "groups")
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
