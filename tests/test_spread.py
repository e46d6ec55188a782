import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from seqspark.plans import tables


def parts(df):
    return {r["p"]: r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()}


def test_a_row_group_of_many_splits_is_dealt_to_all_cores(spark, tmp_path):
    """One row group is read by one task, although its file has more splits than there are cores."""
    rows = [(k, f"text {k} " + "acgt" * 500) for k in range(400)]
    table = pa.table({"doc_id": [k for k, _ in rows], "text": [t for _, t in rows]})
    pq.write_table(table, f"{tmp_path}/documents.parquet", row_group_size=1000, compression="none", use_dictionary=False)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "65536")
        df = spark.read.parquet(f"{tmp_path}/documents.parquet")
        assert df.rdd.getNumPartitions() > 4 and len(parts(df)) == 1
        held = parts(tables.spread(df))
        assert len(held) >= 4 and max(held.values()) < 200
        got = tables.contigs(spark, str(tmp_path)).collect()
        assert sorted((r["contig_id"], len(r["seq"])) for r in got) == [(k, 2004) for k in range(400)]
        even = spark.range(400, numPartitions=8).toDF("doc_id")
        assert parts(tables.spread(even)) == parts(even)
        assert tables.spread(df.where("doc_id < 0")).collect() == []
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
