"""Selecting, sampling and comparing sets of rows. Random choice is a hash of the key, so runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def sample_without_replacement(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """Exactly n rows, the first by hash: a top-k, not a global sort. Raises if there are fewer."""
    out = df.orderBy(draw(F.col(key), seed), key).limit(n)
    if out.count() < n:
        raise ValueError("fewer rows than asked for")
    return out


def balance(df: DataFrame, label: str, key: str, by: str, seed: str = "s") -> DataFrame:
    """As many negatives as positives (label true) in each group of `by`, the first ones by hash.

    The cut is found from counts by the leading three hexadecimal digits of the hash, so that a large group
    is ranked in 4,096 parts and never in one task."""
    rows = df.withColumn("__h", draw(F.col(key), seed)).withColumn("__part", F.substring("__h", 1, 3))
    counts = rows.groupBy(F.col(by).alias("__by"), F.col(label).alias("__label"), "__part").count()
    wanted = counts.where("__label").groupBy(F.col("__by").alias("__own")).agg(F.sum("count").alias("__n"))
    so_far = Window.partitionBy("__by").orderBy("__part")
    others = counts.where("NOT __label").withColumn("__till", F.sum("count").over(so_far)).join(wanted, F.col("__by").eqNullSafe(F.col("__own")), "left")
    n = F.coalesce("__n", F.lit(0))
    edge = others.where(F.col("__till") >= n).groupBy("__by").agg(F.min(F.struct("__part", (n - F.col("__till") + F.col("count")).alias("need"))).alias("__edge"))
    rank = F.row_number().over(Window.partitionBy(by, label, "__part").orderBy("__h", key))
    rows = rows.withColumn("__r", rank).join(edge, F.col(by).eqNullSafe(F.col("__by")), "left")
    last = F.col("__edge.__part")
    kept = F.col("__edge").isNull() | (F.col("__part") < last) | ((F.col("__part") == last) & (F.col("__r") <= F.col("__edge.need")))
    return rows.where(F.col(label) | (~F.col(label) & kept)).select(*df.columns)


def partition_of(key: Column, n: int, seed: str = "s") -> Column:
    """0 .. n - 1, near-equal parts without a shuffle."""
    return (F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") % n).cast("int")


def extract_by_id(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is wanted, wanted keys without a row); raises on keys that occur twice."""
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("duplicate keys")
    return df.join(ids, key, "left_semi"), ids.join(df, key, "left_anti")


def route_by_cluster(df: DataFrame, sites: DataFrame) -> DataFrame:
    """df(site, ...) with the cluster of its site; raises where a site has none."""
    out = df.join(sites.select("site", "cluster"), "site", "left")
    if out.where("cluster IS NULL").limit(1).count():
        raise ValueError("a site has no cluster")
    return out
