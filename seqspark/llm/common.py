"""Helpers that the operators share: tables, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one on a single machine
    (tests); a cluster's executors could not see that, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: later steps survive lost executors
    and do not recompute what lies before."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables written by cut() that no later step reads."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now, not whenever the
    driver happens to collect garbage; the next step needs the disk. A small job comes first:
    the driver still refers to the shuffles of the last one."""
    import gc

    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _local_forest(batches):
    """Each batch of edges as a spanning forest (node, root): same connectivity, fewer edges."""
    for pdf in batches:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]}, dtype="int64")


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) rows with the least v of each u, and the table of these. Both join sides are plain exchanges over written
    tables, so that Spark's adaptive skew join can split a node with very many neighbours."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u"), least


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes; each step is one
    aggregation and one join and is written to the shared folder. Nodes without edges do not
    appear; an empty table gives an empty table; repeated edges and loops do not matter.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    stars = cut(edges.mapInPandas(_local_forest, "a long, b long").where("a <> b"), "forest")
    before = None
    while True:
        old = [stars]
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = cut(both.union(both.select("v", "u")), "both")
        joined, least = _with_least(both)
        large = joined.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
        down = cut(large.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "down")
        old += [both, least, down]
        joined, least = _with_least(down)
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(joined.select(F.col("u"), F.col("m")))
        stars = cut(small.where("a <> b").distinct(), "stars")
        drop(*old, least)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now


def numbered(rows: DataFrame, order: list[str], group: str | None = None, name: str = "place") -> DataFrame:
    """rows with name, their number from 0 on in the order of the columns `order`, gapless over the whole table or
    within each value of the integer column `group`.

    Rows are dealt by ranges of (group, order) and counted within each range, so no task holds a whole group;
    the ranges' counts, a row for each range and group, give where each begins. Rows that are equal in all of
    order cannot be parted into ranges: let order end in a column that tells rows apart, such as row_id().
    rows should be a written table, as it is read twice."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    keys = [*([group] if group else []), *order]

    def count(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            own = np.asarray(batch.column(batch.schema.get_field_index(group))) if group else np.zeros(n, np.int64)
            new = np.concatenate([[True], own[1:] != own[:-1]])
            starts = np.nonzero(new)[0]
            at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            first = n if len(starts) == 1 else starts[1]
            if own[0] == last:
                at[:first] += seen
            last, seen = own[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at.astype(np.int64))], names=[*batch.schema.names, "__part", "__at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(count, schema), "numbered")
    by = [*([group] if group else []), "__part"]
    before = Window.partitionBy(*by[:-1]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*by).agg(F.count("*").alias("__n"))
    bases = counts.select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = placed.join(F.broadcast(bases), by)  # a row for each range, and one more for each group
    return out.select(*rows.columns, (F.col("__base") + F.col("__at")).alias(name))
