"""Shards of near-equal bytes by Karmarkar-Karp differencing; documents with equal texts stay together.

Differencing keeps partial partitions: sums of bytes in as many slots as there are shards. It starts with one
partial partition for each item (the item in one slot, the others empty) and, again and again, combines the
two with the largest spread, the fullest slot of one with the emptiest of the other, until one is left.

That is a sequential procedure, so it runs as a tree of bounded steps in Spark tasks. Groups of equal texts
are dealt by a hash into buckets of about BUCKET; each bucket is differenced into slots of its own. The slots
of FAN buckets are the items of a next step, and so on up to one last step. Two kinds of groups skip the tree
and are items of the last step themselves: large ones, with more than 1 / (shards x FAN) of all bytes (fewer
than shards x FAN by that), because parts that are balanced already cannot make up for them; and about FINE
others, picked by a hash, because the slots come in nearly equal sizes and only small items even out the
rest. So the last step has about 2 x FAN x shards + FINE items at most, whatever the input, and an earlier one
FAN x shards. Each step writes where a slot goes (`shards` rows a bucket); a document's shard follows from its
group's path by joins. A group is never divided, so a shard can hold more than its part only where one group
alone does.

Positions within a shard come from ranges of (shard, id) that are counted one by one.

Defined results for odd rows: a null text counts as an empty one, and all of these are one group; a null doc_id
comes first in its shard; repeated rows are separate documents of one group; groups are told apart by a
64-bit hash, so that texts whose hashes agree stay together as well; an empty table gives an empty table;
other columns are ignored; with more shards than groups some stay empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import cut, numbered

SHARDS, OVERHEAD, LAW = 40, 16, "bytes"
#: Groups in a bucket of the first step, about; buckets whose slots are the items of one step above; groups that go to the last step.
BUCKET, FAN, FINE = 20_000, 250, 20_000


def differencing(sizes: np.ndarray, ways: int) -> np.ndarray:
    """The slot (0 to ways - 1) of each item by Karmarkar-Karp differencing; ties go by the items' order."""
    n = len(sizes)
    if not n:
        return np.empty(0, np.int64)
    # Partial partitions 0 to n - 1 are items, those from n on combinations; a row of sums, in falling order, is reused by the combination.
    sums = np.zeros((n, ways), np.int64)
    sums[:, 0] = sizes
    row = np.arange(2 * n - 1)
    left, right, turn = (np.zeros(x, np.int64) for x in (n - 1, n - 1, (n - 1, ways)))
    spread = sums[:, 0] - (sums[:, -1] if ways > 1 else 0)
    heap = [(-s, i) for i, s in enumerate(spread.tolist())]
    heapq.heapify(heap)
    for new in range(n, 2 * n - 1):
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = sums[row[a]] + sums[row[b]][::-1]
        order = np.argsort(-both, kind="stable")
        left[new - n], right[new - n], turn[new - n], row[new] = a, b, order, row[a]
        sums[row[a]] = both = both[order]
        heapq.heapreplace(heap, (int(both[-1] - both[0]), new))
    # From the last combination back: where each slot of a partial partition ends up.
    place = {2 * n - 2: np.arange(ways)}
    out = np.empty(n, np.int64)
    for k in range(2 * n - 2, n - 1, -1):
        own, order = place.pop(k), turn[k - n]
        one, two = np.empty(ways, np.int64), np.empty(ways, np.int64)
        one[order], two[ways - 1 - order] = own, own
        place[int(left[k - n])], place[int(right[k - n])] = one, two
    for i, own in place.items():
        out[i] = own[0]
    return out


STEP = "node long, direct boolean, key long, slot int, size long"


def _step(ways: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Items (node, direct, key, size) of one node with the slot each of them gets."""

    def difference(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "direct", "key"], ascending=[False, True, True], ignore_index=True)
        return pdf.assign(slot=differencing(pdf["size"].to_numpy(), ways).astype(np.int32))[[x.split()[0] for x in STEP.split(", ")]]

    return difference


def assign(groups: DataFrame, ways: int = SHARDS, bucket: int = BUCKET, fan: int = FAN, fine: int = FINE) -> DataFrame:
    """groups(key, size), keys distinct, as (key, shard)."""
    n, total = groups.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return groups.select("key", F.lit(0).alias("shard"))
    nodes, no = max(1, -(-n // bucket)), F.lit(False)
    skips = (F.col("size") * F.lit(ways * fan) > F.lit(total)) | (F.pmod(F.xxhash64("key", F.lit("fine")), F.lit(n)) < fine)
    marked = groups.select("key", "size", skips.alias("direct"))
    step = lambda items: cut(items.groupBy("node").applyInPandas(_step(ways), STEP), "step")
    slot = (F.col("node") * ways + F.col("slot")).alias("key")
    slots = lambda parts: parts.groupBy("node", "slot").agg(F.sum("size").alias("size"))

    first = parts = step(marked.where("NOT direct").select(F.pmod(F.xxhash64("key"), F.lit(nodes)).alias("node"), no.alias("direct"), "key", "size"))
    moves = []
    while nodes > fan:
        parts = step(slots(parts).select(F.floor(F.col("node") / fan).alias("node"), no.alias("direct"), slot, "size"))
        moves.append(parts)
        nodes = -(-nodes // fan)
    items = slots(parts).select(no.alias("direct"), slot, "size").union(marked.where("direct").select("direct", "key", "size"))
    last = step(items.select(F.lit(0).cast("long").alias("node"), "direct", "key", "size"))

    place = first.select(F.col("key").alias("group"), slot)
    for own in [*moves, last.where("NOT direct")]:
        place = place.join(own.select("key", slot.alias("__next")), "key").select("group", F.col("__next").alias("key"))
    ends = place.union(last.where("direct").select("key", slot))  # the last step has node 0, so its slots are the shards
    return ends.select(F.col("group").alias("key"), F.col("key").cast("int").alias("shard"))


def shards(docs: DataFrame, ways: int = SHARDS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows, "rows")
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    placed = cut(rows.join(cut(assign(groups, ways), "shards"), "key"), "placed")
    out = numbered(placed, ["doc_id", "key", "row"], "shard", "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
