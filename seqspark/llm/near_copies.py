"""SimHash near copies by similarity: texts whose sets of five-word shingles have Jaccard >= SIMILAR.

Texts with equal shingle sets are collapsed first. Every set has a SimHash fingerprint of BITS bits; those of sets at Jaccard 0.8
differ in 38.8 bits (0.8 and a normal angle; deviation 5.7). No block of bits narrows that radius down without loss, so sets meet
by their shingles: put all shingles in one order, and of a set of n the first n - 0.8 n + 1. Two near copies have 0.8 n of either's
shingles in common, so the first of these stands in both beginnings: every pair of near copies meets, whatever the order. The
order is that of the hashes, with common shingles (of a sample of the texts, see common_shingles()) last, so that a passage of very
many texts seldom brings them together; a sample that knows it badly costs time and loses nothing.

Sets that meet are compared by size and by exclusive-or and bit counts of their fingerprints, as op3's are. RADIUS and
RADIUS_SHORT are passed by less than one in 10^10 pairs of near copies (binomial tail of the sets of up to 250 shingles
whose bits differ most). Meeting sets give a spanning forest of their likely pairs, not the pairs: what is written grows
with the members of a bucket. The texts of a tree's members are then compared whole, every pair of them by the sizes of
their intersections; again only a spanning forest of the near copies is written. Both steps cut large groups into pairs of tiles,
bounded by TILE members (and BYTES of text); members of a large bucket that are alike with its least key, and so linked with
each other, are compared with the others only.

Defined results for odd rows: null and blank texts have the empty set and are one group; a text of
fewer than WORDS words is one shingle; rows with one key must have one text; an empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import components, cut
from seqspark.llm.token_parquet import pieces

WORDS, SIMILAR, SEED = 5, 0.8, 42
#: Fingerprint bits; uncertain bits of a block that are changed; largest set that counts as short.
BITS, FLIPS, SHORT = 256, 2, 40
#: Bits in which near copies may differ; the same for short sets, whose bits are tied more often.
RADIUS, RADIUS_SHORT = 80, 92
#: Members of a tile of fingerprints and of texts; bytes of text in a tile; members up to which all pairs of a bucket are laid out.
TILE, TEXTS, BYTES, FEW = 4096, 1024, 16 << 20, 8
#: Texts of the sample that tells common shingles, texts of it that hold one at least, and how many are kept.
SAMPLE, COMMON, MOST_COMMON = 8192, 8, 1 << 19

_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, BITS // 64, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_SUBSETS = (np.arange(1 << FLIPS)[:, None] >> np.arange(FLIPS)) & 1


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 text."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    tail: list[bytes] = []
    parts = []
    for piece in pieces((text or b"").lower()):
        tail += piece.split()
        if len(tail) < words:
            continue
        parts.append(np.array([digest(join(x), SEED) for x in zip(*(tail[i:] for i in range(words)))], dtype=np.uint64))
        tail = tail[1 - words :] if words > 1 else []
    if not parts and tail:
        parts.append(np.array([digest(join(tail), SEED)], dtype=np.uint64))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprint(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(BITS bits, how far each is from changing) of a set of 64-bit hashes: a bit is set where over half of the mixed hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        x = hashes[at : at + (1 << 13)] + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(_MIX), -1, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.int64).ravel()
    return ones * 2 > len(hashes), np.abs(ones * 2 - len(hashes))


def weakest(margin: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """The places in each block of its FLIPS least certain bits."""
    return np.argsort(margin[: width * blocks].reshape(blocks, width), axis=1, kind="stable")[:, :FLIPS].astype(np.uint8)


def buckets_of(fp: np.ndarray, weak: np.ndarray, width: int, blocks: int) -> np.ndarray:
    """For each row of fingerprints fp (bytes) with weakest() bits weak the values under which it meets others."""
    powers = 1 << np.arange(width)
    bits = np.unpackbits(fp, axis=1, bitorder="little")[:, : width * blocks].reshape(-1, blocks, width)
    values = (bits @ powers)[:, :, None] ^ (powers[weak.reshape(-1, blocks, FLIPS)] @ _SUBSETS.T)
    return (values + (np.arange(blocks)[:, None] << width)).reshape(len(fp), -1)


def least_of(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The first hashes of a set, of which two near copies share one; shingles of common (sorted hashes, ranks) are the last in order."""
    n = len(hashes)
    if common is not None and n and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        last = np.flatnonzero(common[0][at] == hashes)
        if len(last):
            hashes = np.concatenate([np.delete(hashes, last), hashes[last[np.argsort(common[1][at[last]])]]])
    return hashes[: n - (4 * n + 4) // 5 + 1]


def common_shingles(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, ranks) of the shingles that COMMON of about SAMPLE texts hold, the more the higher in rank; MOST_COMMON at most.

    They only say which shingles come last in the order by which sets meet; any list gives the same groups."""

    def run(batches):
        for pdf in batches:
            sets = [shingle_set(t) for t in pdf["text"]]
            yield pd.DataFrame({"hash": np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)})

    picked = texts.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(max(1, total))) < SAMPLE)
    counts = picked.mapInPandas(run, "hash long").groupBy("hash").count().where(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "hash").limit(MOST_COMMON).toPandas()
    hashes = found["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(found) - np.arange(len(found)))[order]


def _sketch(common):
    def run(batches):
        import xxhash

        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                own = shingle_set(text)
                bits, _ = fingerprint(own)
                out.append((key, xxhash.xxh3_128_digest(own.tobytes()), len(own), np.packbits(bits, bitorder="little").tobytes(), least_of(own, common.value).tobytes()))
            yield pd.DataFrame(out, columns=["key", "digest", "n", "fp", "least"])

    return run


def _places(batches):
    """A row for each set and shingle by which it meets others."""
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        least = column("least").to_pylist()
        rows = np.repeat(np.arange(len(least)), [len(x) // 8 for x in least])
        values = np.frombuffer(b"".join(least), np.int64)
        for at in range(0, len(rows), 1 << 16):
            own = pa.array(rows[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(values[at : at + (1 << 16)]), *(column(c).take(own) for c in ("rep", "n", "fp"))], names=["bucket", "key", "n", "fp"])


class Forest:
    """Trees over numbered nodes: links that join two trees are kept, all others are not needed."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tree, self.links = keys, np.unique(keys, return_inverse=True)[1], []

    def join(self, i: int, others: np.ndarray) -> None:
        """Links node i with others."""
        trees, first = np.unique(self.tree[others], return_index=True)
        for tree, at in zip(trees.tolist(), first.tolist(), strict=True):
            if tree != self.tree[i]:
                self.links.append((self.keys[i], self.keys[others[at]]))
                self.tree[self.tree == tree] = self.tree[i]

    def batch(self) -> pa.RecordBatch:
        a, b = np.array(self.links, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def radius(n, m):
    """Bits in which the fingerprints of near copies of n and m shingles may differ."""
    return np.where(np.minimum(n, m) <= SHORT, RADIUS_SHORT, RADIUS)


def _grid(members: DataFrame, by: str, slots, columns: list[str]) -> DataFrame:
    """members(by, key, near, columns) as (by, left, right), a row for each pair of tiles. left has all members of a group, right those that
    are not near, in which a pair's second stands; it is empty where one tile has them all. slots is an aggregate, the number of tiles
    of the members for which its argument holds."""
    sizes = members.groupBy(by).agg(slots(F.lit(True)).alias("slots"), slots(~F.col("near")).alias("others"))
    rows = members.join(sizes, by)
    at = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    side = lambda left, x, y: F.struct(F.lit(left).alias("left"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    own, other = at(F.col("slots"), 1), at(F.col("others"), 2)
    left = F.transform(every(F.col("others")), lambda y: side(True, own, y))
    right = F.when((F.col("slots") > 1) & ~F.col("near"), F.transform(every(F.col("slots")), lambda x: side(False, x, other))).otherwise(F.array().cast("array<struct<left:boolean,x:int,y:int>>"))
    rows = rows.where("others > 0").select(by, "key", "near", *columns, F.explode(F.concat(left, right)).alias("to"))
    item = F.struct("key", "near", *columns)
    tiles = rows.groupBy(by, F.col("to.x").alias("x"), F.col("to.y").alias("y")).agg(F.collect_list(F.when(F.col("to.left"), item)).alias("left"), F.collect_list(F.when(~F.col("to.left"), item)).alias("right"))
    return tiles.where("size(left) > 0 AND size(left) + size(right) > 1").select("left", "right")


def _likely(members: DataFrame) -> DataFrame:
    """Links (a, b) that join what members(bucket, key, n, fp) of one bucket may be near copies, by size and fingerprint."""
    met = members.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(TILE), "bucket long, key long, n int, fp binary, other long")
    met = cut(met, "met")
    rows = met.where("other IS NULL").drop("other")
    hubs = cut(rows.groupBy("bucket").agg(F.min(F.struct("key", "n", "fp")).alias("hub")), "hubs")
    marked = cut(rows.join(hubs, "bucket").mapInArrow(_near_hub, "bucket long, key long, n int, fp binary, near boolean, hub long"), "marked")
    count = lambda own: F.ceil(F.count(F.when(own, 1)) / TILE).cast("int")
    tiles = _grid(marked, "bucket", count, ["n", "fp"]).mapInArrow(_compare, "a long, b long")
    links = met.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b"))
    return links.union(tiles).union(marked.where("near AND hub <> key").select(F.col("hub").alias("a"), F.col("key").alias("b"))).distinct()


def _meet(tile: int):
    """Of rows (bucket, key, n, fp) in order of bucket the links (key, other) within buckets of up to tile rows; the rows of larger ones stay rows."""

    def links(bucket, key, n, words):
        """Links of whole buckets, and the numbers of the rows of large ones."""
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        sizes = np.diff(np.append(starts, len(bucket)))
        pairs, large = [], [np.empty(0, int)]
        for size in range(2, min(FEW, tile) + 1):
            own = starts[sizes == size]
            for i, j in zip(*np.triu_indices(size, 1), strict=True):
                x, y = own + i, own + j
                fine = _alike(n[x], n[y], np.bitwise_count(words[x] ^ words[y]).sum(axis=1))
                pairs.append((key[x[fine]], key[y[fine]]))
        for start, size in zip(starts[sizes > min(FEW, tile)].tolist(), sizes[sizes > min(FEW, tile)].tolist(), strict=True):
            own = slice(start, start + size)
            if size > tile:
                large.append(np.arange(start, start + size))
                continue
            forest, k, w = Forest(key[own]), n[own], words[own]
            near = _alike(k, k[0], np.bitwise_count(w ^ w[0]).sum(axis=1))
            forest.join(0, np.flatnonzero(near))
            _join_alike(forest, k, w, size, np.flatnonzero(~near))
            if forest.links:
                pairs.append(np.array(forest.links, np.int64).T)
        return pairs, np.concatenate(large)

    def run(batches):
        rows, held, passed = [], 0, None  # batches of the bucket that is not at its end, their rows, and its name once it is too large to hold
        names = ["bucket", "key", "n", "fp", "other"]
        as_rows = lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.int64())], names=names)
        as_links = lambda a, b: pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(np.minimum(a, b)), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.array(np.maximum(a, b))], names=names)

        def close(parts):
            batch = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
            bucket, key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "key", "n"))
            pairs, large = links(bucket, key, n, _words(batch.column("fp")))
            pairs = [p for p in pairs if len(p[0])]
            if pairs:
                yield as_links(*(np.concatenate(side) for side in zip(*pairs, strict=True)))
            if len(large):
                yield as_rows(batch.take(pa.array(large)))

        for batch in batches:
            if not len(batch):
                continue
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            begin = 0
            if passed is not None:
                begin = int(np.searchsorted(bucket, passed, "right"))
                if begin:
                    yield as_rows(batch.slice(0, begin))
                if begin == len(batch):
                    continue
                passed = None
            last = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if last > begin:
                yield from close([*rows, batch.slice(begin, last - begin)])
                rows, held = [], 0
                begin = last
            elif rows and rows[-1].column("bucket")[0].as_py() != bucket[-1]:
                yield from close(rows)
                rows, held = [], 0
            rows.append(batch.slice(begin))
            held += len(batch) - begin
            if held > tile:
                yield from map(as_rows, rows)
                rows, held, passed = [], 0, bucket[-1]
        if rows:
            yield from close(rows)

    return run


def _alike(n, m, apart):
    """Whether sets of n and m shingles whose fingerprints differ in so many bits may be near copies."""
    return (apart <= radius(n, m)) & (np.minimum(n, m) >= SIMILAR * np.maximum(n, m))


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, BITS // 64)


def _near_hub(batches):
    """Rows of large buckets with whether they are alike with the bucket's least key."""
    for batch in batches:
        n, fp = batch.column("n").to_numpy(zero_copy_only=False), _words(batch.column("fp"))
        hub, of_n, of_fp = batch.column("hub").flatten()
        of_n, apart = of_n.to_numpy(zero_copy_only=False), np.bitwise_count(fp ^ _words(of_fp)).sum(axis=1)
        near = _alike(n, of_n, apart)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "key", "n", "fp")), pa.array(near), hub], names=["bucket", "key", "n", "fp", "near", "hub"])


def _sides(batch, k: int):
    """(fields of the rows of both sides, numbers of those in which a pair's second stands) of a tile."""
    left, right = (batch.column(c).slice(k, 1).flatten() for c in ("left", "right"))
    own = not len(right)
    rows = left if own else pa.concat_arrays([left, right])
    near = rows.field(1).to_numpy(zero_copy_only=False)
    return [rows.field(j) for j in range(rows.type.num_fields)], len(left), np.flatnonzero(~near) if own else np.arange(len(left), len(rows))


def _join_alike(forest: Forest, n, fp, size: int, second, step: int = 64) -> None:
    """Links those of the first `size` rows with the rows `second` that may be near copies."""
    ones = np.bitwise_count(fp).sum(axis=1).astype(int)
    second = second[np.argsort(ones[second], kind="stable")]
    order, lie = np.argsort(ones[:size], kind="stable"), ones[second]
    for at in range(0, size, step):
        x = order[at : at + step]
        lo, hi = np.searchsorted(lie, ones[x[0]] - RADIUS_SHORT), np.searchsorted(lie, ones[x[-1]] + RADIUS_SHORT, "right")
        y = second[lo:hi]
        apart = sum(np.bitwise_count(fp[x, w][:, None] ^ fp[y, w][None]).astype(np.int16) for w in range(BITS // 64))
        near = _alike(n[x][:, None], n[y][None], apart)
        near &= forest.keys[x][:, None] != forest.keys[y][None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            forest.join(int(x[i]), y[near[i]])


def _compare(batches):
    for batch in batches:
        for k in range(len(batch)):
            (key, _, n, fp), size, second = _sides(batch, k)
            forest = Forest(key.to_numpy(zero_copy_only=False))
            _join_alike(forest, n.to_numpy(zero_copy_only=False), _words(fp), size, second)
            if forest.links:
                yield forest.batch()


def _verify(batches):
    """Links between those texts of a tile that are near copies."""
    for batch in batches:
        for k in range(len(batch)):
            (key, _, text), size, second = _sides(batch, k)
            sets = [shingle_set(t) for t in text.to_pylist()]
            forest = Forest(key.to_numpy(zero_copy_only=False))
            n = np.array([len(x) for x in sets])
            place = np.repeat(np.arange(len(second)), n[second])
            values = np.concatenate([sets[j] for j in second])
            order = np.argsort(values, kind="stable")
            values, place = values[order], place[order]
            step = max(1, (1 << 22) // max(1, len(second)))
            for i in range(size):
                both = np.zeros(len(second), np.int64)
                for at in range(0, n[i], step):
                    part = sets[i][at : at + step]
                    lo, hi = np.searchsorted(values, part), np.searchsorted(values, part, "right")
                    till = np.cumsum(hi - lo)
                    both += np.bincount(place[np.arange(till[-1]) + np.repeat(hi - till, hi - lo)], minlength=len(second))
                near = both / np.maximum(n[i] + n[second] - both, 1) >= SIMILAR
                if near.any():
                    forest.join(i, second[near])
            if forest.links:
                yield forest.batch()


def _verify_hubs(batches):
    """Rows (root, key, text, hub, hub_text) of large groups with whether the text is a near copy of its group's least key's."""
    last, of_last = None, None
    for pdf in batches:
        near = []
        for hub, text, hub_text in zip(pdf["hub"], pdf["text"], pdf["hub_text"], strict=True):
            if hub != last:
                last, of_last = hub, shingle_set(hub_text)
            near.append(jaccard(shingle_set(text), of_last) >= SIMILAR)
        yield pdf[["root", "key", "text", "hub"]].assign(near=near)


def _links(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join near copies among groups(node, root) of texts(key, text)."""
    members = texts.join(groups.withColumnRenamed("node", "key"), "key").dropDuplicates(["key"]).select("root", "key", "text")
    members = cut(members, "members")
    size = lambda own: F.ceil(F.greatest(F.count(F.when(own, 1)) / TEXTS, F.sum(F.when(own, F.length("text")).otherwise(0)) / BYTES)).cast("int")
    large = cut(members.groupBy("root").agg(size(F.lit(True)).alias("slots")).where("slots > 1").select("root"), "large")
    small = members.join(large, "root", "left_anti").groupBy("root").agg(F.collect_list(F.struct("key", F.lit(False).alias("near"), "text")).alias("left"))
    small = small.select("left", F.array().cast(small.schema["left"].dataType).alias("right"))
    hubs = cut(members.join(large, "root", "left_semi").where("key = root").select("root", F.col("key").alias("hub"), F.col("text").alias("hub_text")), "hubs")
    marked = cut(members.join(hubs, "root").mapInPandas(_verify_hubs, "root long, key long, text binary, hub long, near boolean"), "marked")
    found = small.union(_grid(marked, "root", size, ["text"])).mapInArrow(_verify, "a long, b long")
    return cut(found.union(marked.where("near AND hub <> key").select("hub", "key")), "links")


def near_copies(docs: DataFrame) -> DataFrame:
    """docs(key, text) as (key, component_id), one row per key; a component is named by its least key."""
    texts = docs.select("key", F.col("text").cast("binary").alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, texts.count()))
    rows = cut(texts.mapInPandas(_sketch(common), "key long, digest binary, n int, fp binary, least binary"), "sketches")
    reps = cut(rows.groupBy("digest").agg(F.min("key").alias("rep"), *(F.first(c).alias(c) for c in ("n", "fp", "least"))), "reps")
    likely = cut(_likely(reps.mapInArrow(_places, "bucket long, key long, n int, fp binary")), "likely")
    roots = components(_links(components(likely), texts)).withColumnRenamed("node", "rep")
    groups = cut(reps.join(roots, "rep", "left").select("digest", F.coalesce("root", "rep").alias("component_id")), "groups")
    return rows.select("key", "digest").join(groups, "digest").select("key", "component_id").distinct()
