"""Mixing sources to target weights: whole copies first, then Pareto order sampling.

A source's target is its weight's share of all words, at most CAP times its own size; the excess
of capped sources is shared out again by weight. Within a source a document is to be taken more
often the longer it is: its expected copies r are proportional to the number of binary digits of
its length in bytes, at most CAP, so that all expected words are the target. It has floor(r) certain
copies and one more with inclusion probability p = r - floor(r). Documents are ranked by random odds
over inclusion odds, (u/(1-u)) / (p/(1-p)), and the ranking is cut where the words taken come
closest to the target.

u comes from a hash of id and text. Rows that agree in both (and in the source) share a rank; the cut
may fall among them and then takes as many of them as it needs. The cut is found without sorting a
source in one task: words are summed by BUCKETS intervals of the rank, and only the interval that
holds the cut is ordered row by row.

Defined results for odd rows: a null text has size 0 and is taken like any other document of no
words; null sources form one source, the last; a null doc_id counts as the text 'null'; other
columns are ignored or, in mix(), kept; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import cut

WEIGHTS, CAP, BUCKETS, SEED = (1, 2, 3), 3, 4096, "mix"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits_of(text: Column) -> Column:
    """Binary digits of the length of text in bytes."""
    return F.length(F.bin(F.coalesce(F.octet_length(text), F.lit(0)).cast("long")))


def key_of(doc_id: Column, text: Column) -> Column:
    """A hash of id and text, whose first 52 bits are the random number u."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(SEED), own).cast("binary"))


def random_of(key: Column) -> Column:
    """A number strictly between 0 and 1."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, size) as one row per source: (source, source_size, target).

    Sources are put in order of cap * size / weight; if all before one are capped, the level of
    the rest is (words left) / (weight left), and the first level that does not pass its source's
    own ratio is the one. One row per source goes through the window without partitions.
    """
    n = len(weights)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1)
    rows = rows.select("source", "source_size", weight.cast("double").alias("weight"))
    rows = rows.withColumn("ratio", F.col("source_size") * cap / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(everything) - cap * so_far("source_size")) / (F.sum("weight").over(everything) - so_far("weight")),
    ).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return rows.select("source", "source_size", F.least(F.col("source_size") * float(cap), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def shares(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """sizes(source, size, digits) as one row per source and digits: (source, digits, source_size,
    target, copies, p, rest); rest is the words that a source takes beyond certain copies."""
    goals = targets(sizes, cap=cap).withColumnRenamed("source", "s")
    rows = sizes.groupBy("source", "digits").agg(F.sum("size").alias("words"))
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # The longest texts reach the cap first; as for sources, the first level within its own ratio holds.
    by, all_ = Window.partitionBy("source").orderBy(F.desc("digits")), Window.partitionBy("source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    weighted = F.col("words") * F.col("digits")
    level = F.try_divide(F.col("target") - cap * so_far("words"), F.sum(weighted).over(all_) - so_far(weighted))
    rows = rows.withColumn("level", level).withColumn("ratio", F.lit(float(cap)) / F.col("digits"))
    rows = rows.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.struct("digits", "level"))).over(all_)["level"])
    r = F.when(F.col("target") > 0, F.least(F.lit(float(cap)), F.coalesce(F.col("level") * F.col("digits"), F.lit(float(cap))))).otherwise(0.0)
    rows = rows.withColumn("r", r).withColumn("copies", F.floor("r").cast("int"))
    rows = rows.withColumn("rest", F.col("target") - F.sum(F.col("copies") * F.col("words")).over(all_))
    return rows.select("source", "digits", "source_size", "target", "copies", (F.col("r") - F.col("copies")).alias("p"), "rest")


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, digits, key, ...) with the columns of plan for their source and digits, named __x, and
    __rank in (0, 1): the ratio q of odds as q / (1 + q)."""
    joined = rows.join(plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns}), F.col("source").eqNullSafe(F.col("__source")) & (F.col("digits") == F.col("__digits")))
    u, p = random_of(F.col("key")), F.col("__p")
    odds = u / (1 - u) / (p / (1 - p))
    return joined.withColumn("__rank", F.when(p > 0, odds / (1 + odds)).otherwise(1.0))


def plan(sizes: DataFrame) -> DataFrame:
    """sizes(source, size, digits, key) as shares() with the source's cut: rows with p > 0 and (rank, key)
    before (last_rank, last_key) take a copy more, and so do `more` of the `equal` rows at that place."""
    goals = cut(shares(sizes), "shares")
    alike = sizes.groupBy("source", "digits", "size", "key").agg(F.count("*").alias("equal"))
    rows = _ranked(alike, goals).where("__p > 0").select("source", "key", "size", "equal", F.col("__rest").alias("rest"), F.col("__rank").alias("rank"))
    rows = rows.withColumn("words", F.col("size") * F.col("equal")).withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int"))

    # Where the sums by bucket pass the rest: one row per source, at most BUCKETS rows go into its window.
    sums = rows.groupBy("source", "rest", "bucket").agg(F.sum("words").alias("words"))
    sums = sums.withColumn("till", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    edge = sums.where("till + 0.5 >= rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("till") - F.col("words")).alias("before"))).alias("e"))
    edge = cut(edge.select(F.col("source").alias("es"), F.col("e.bucket").alias("eb"), F.col("e.before").alias("before")), "edges")

    inside = rows.join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("bucket") == F.col("eb")))
    inside = inside.withColumn("till", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("rank", "key")))
    last = inside.where("till + 0.5 >= rest").groupBy("source").agg(F.min(F.struct("rank", "key", "equal", "size", "rest", (F.col("till") - F.col("words")).alias("before"))).alias("e")).select("source", "e.*")
    # The number of them that comes closest to the rest, the smaller one if two do.
    best = F.ceil(F.try_divide(F.col("rest") - F.col("before"), F.col("size")) - 0.5)
    last = last.select(F.col("source").alias("ls"), F.col("rank").alias("last_rank"), F.col("key").alias("last_key"), "equal", F.greatest(F.lit(0), F.least("equal", F.coalesce(best, F.col("equal")))).cast("long").alias("more"))
    return cut(goals.join(last, F.col("source").eqNullSafe(F.col("ls")), "left").drop("ls", "rest"), "plan")


def _first_of(rows: DataFrame) -> DataFrame:
    """rows(source, __more, ...) of alike rows, the first __more of each source marked as __extra.

    Rows are numbered within the partitions of a written table, after the rows of the partitions before."""
    rows = cut(rows.withColumn("__n", F.monotonically_increasing_id()), "alike")
    rows = rows.withColumn("__part", F.shiftright("__n", 33))
    counts = rows.groupBy("source", "__part").count()
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("__s"), F.col("__part").alias("__p2"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p2")))
    number = F.col("__before") + F.row_number().over(Window.partitionBy("source", "__part").orderBy("__n"))
    return rows.withColumn("__extra", F.when(number <= F.col("__more"), 1).otherwise(0))


def with_copies(rows: DataFrame, source_plan: DataFrame) -> DataFrame:
    """rows(source, digits, key, ...) with __size and __goal of their source and __times, the times that
    each is taken. The plan has one row per source and number of digits; Spark broadcasts it only where its
    own size check allows."""
    ranked = _ranked(rows, source_plan)
    before = (F.col("__rank") < F.col("__last_rank")) | ((F.col("__rank") == F.col("__last_rank")) & (F.col("key") < F.col("__last_key")))
    at = F.coalesce((F.col("__p") > 0) & (F.col("__rank") == F.col("__last_rank")) & (F.col("key") == F.col("__last_key")), F.lit(False))
    parted = at & (F.col("__more") > 0) & (F.col("__more") < F.col("__equal"))
    extra = F.when(at, (F.col("__more") > 0).cast("int")).when((F.col("__p") > 0) & F.coalesce(before, F.lit(False)), 1).otherwise(0)
    out = [*rows.columns, F.col("__source_size").alias("__size"), F.col("__target").alias("__goal"), (F.col("__copies") + F.col("__extra")).alias("__times")]
    if source_plan.where("more > 0 AND more < equal").isEmpty():
        return ranked.withColumn("__extra", extra).select(*out)
    return ranked.where(~parted).withColumn("__extra", extra).select(*out).union(_first_of(ranked.where(parted)).select(*out))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("source").cast("string").alias("source"), digits_of(F.col("text")).alias("digits"), key_of(F.col("doc_id"), F.col("text")).alias("key"), *more)


def sizes_of(docs: DataFrame) -> DataFrame:
    return cut(_keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), size_of(F.col("text")).alias("size")), "sizes")


def report(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, text) as (doc_id, size, source_size, target, taken)."""
    sizes = sizes_of(docs)
    return with_copies(sizes, plan(sizes)).select(
        "doc_id", "size", F.col("__size").alias("source_size"), F.col("__goal").alias("target"), (F.col("size") * F.col("__times")).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, each as many times as the mix takes it."""
    source_plan = plan(sizes_of(docs))
    whole = _keyed(docs, F.struct(*(docs[c] for c in docs.columns)).alias("__doc"))  # no name can clash
    taken = with_copies(whole, source_plan).where("__times > 0")
    return taken.select("__doc", F.explode(F.expr("sequence(1, __times)")).alias("__time")).select("__doc.*")
