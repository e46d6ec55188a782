"""Sequences and gene structures derived from the driver's tables, the same ones in DuckDB's SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER = "".join(map(chr, range(65, 91)))
LETTERS = _UPPER.lower() + _UPPER
MAPPED = "".join("ACGT"[i % 4] for i in range(26)) * 2
MEDOIDS = [(1, "ACGTAATGCCA"), (2, "CCGTCATGGTA"), (3, "TTAGAATGACG")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig_id, seq): every document's letters as bases."""
    rows = spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("contig_id"), F.col("text").cast("binary").alias("seq")))
    key = rows.schema["contig_id"].dataType.simpleString()
    return rows.mapInArrow(_bases, f"contig_id {key}, seq string")


_TABLE = bytes.maketrans(LETTERS.encode(), MAPPED.encode())
_OTHERS = bytes(set(range(256)) - set(LETTERS.encode()))


def _bases(batches):
    """Letters of UTF-8 text as bases, all other bytes left out."""
    for batch in batches:
        seqs = [None if x is None else x.translate(_TABLE, _OTHERS).decode() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.string())], names=["contig_id", "seq"])


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where few tasks would hold most of its rows, else as it is.

    A Parquet row group is read by one task, however many splits its file has, so splits tell nothing: rows are counted
    by task, for which no column is read. Equal rows go together, others are dealt by their hash."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    if not held["total"] or held["most"] * cores <= 2 * held["total"]:
        return df
    return df.repartition(max(cores, df.rdd.getNumPartitions()), *df.columns)


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, seq): contigs of 350 bases or more, cut so that the coding part is a multiple of three."""
    n = F.length("seq")
    rows = contigs(spark, sf_dir).where(n >= 350)
    return rows.select(F.col("contig_id").alias("seq_id"), F.substring("seq", F.lit(1), (200 + 3 * F.floor((n - 200) / 3)).cast("int")).alias("seq"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, contig_id, strand, parts) with the exons of a gene as parts (exon_no, start, stop), in order: an order's items are shuffled once, by
    the order key, and only genes meet the contigs' lengths."""
    docs = read(spark, sf_dir, "documents")
    n = docs.count()
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = items.select(
        F.col("l_orderkey").alias("gene"), (F.col("l_orderkey") % n).alias("contig_id"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.row_number().over(own).alias("exon_no"), (10 + F.col("l_partkey") % 60).alias("e"), (41 + F.col("l_suppkey") % 50).alias("i"),
    )
    before = Window.partitionBy("gene").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("a", 121 + F.coalesce(F.sum(F.col("e") + F.col("i")).over(before), F.lit(0)))
    rows = rows.groupBy("gene", "contig_id", "strand").agg(F.array_sort(F.collect_list(F.struct("exon_no", "a", (F.col("a") + F.col("e") - 1).alias("b")))).alias("parts"))
    rows = rows.join(contigs(spark, sf_dir).select("contig_id", F.length("seq").alias("n")), "contig_id")
    place = lambda c: F.when(F.col("strand") == "-", F.col("n") - c + 1).otherwise(c)
    return rows.select("gene", "contig_id", "strand", F.transform("parts", lambda p: F.struct(p["exon_no"].alias("exon_no"), place(p["a"]).alias("start"), place(p["b"]).alias("stop"))).alias("parts"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons of genes from lineitem, on the contig that the order key picks; see EXONS."""
    return genes(spark, sf_dir).select("gene", "contig_id", "strand", F.explode("parts").alias("p")).select("gene", "contig_id", "strand", "p.*")


CONTIGS = f"contigs AS (SELECT doc_id AS contig_id, regexp_replace(translate(text, '{LETTERS}', '{MAPPED}'), '[^ACGT]', '', 'g') AS seq FROM documents)"
SEQS = f"{CONTIGS}, seqs AS (SELECT contig_id AS seq_id, substr(seq, 1, CAST(200 + 3 * ((length(seq) - 200) // 3) AS INT)) AS seq FROM contigs WHERE length(seq) >= 350)"
SITES = f"""{SEQS}, mets AS (SELECT seq_id, CAST(pos AS INT) AS pos, substr(seq, CAST(pos AS INT) - 5, 11) AS site, CAST(length(seq) AS INT) AS len
    FROM (SELECT *, unnest(range(102, length(seq) - 100, 3)) AS pos FROM seqs) WHERE substr(seq, CAST(pos AS INT), 3) = 'ATG')"""
LABELLED = f"""{SITES}, lab AS (SELECT * FROM (SELECT *, CASE WHEN pos = f THEN 'T' WHEN pos >= f + 105 THEN 'F' END AS hyp FROM (SELECT *, min(pos) OVER (PARTITION BY seq_id) AS f FROM mets)) WHERE hyp IS NOT NULL)"""
_SMOOTH = "CASE WHEN max(p) OVER w < 0.0005 THEN 0.25 WHEN min(p) OVER w < 0.0005 THEN CASE WHEN p < 0.0005 THEN 0.05 ELSE p * (1 - 4 * 0.05) + 0.05 END ELSE p END"
BASES = "(SELECT unnest(['A', 'C', 'G', 'T']) AS base)"
WAM = f"""{LABELLED}, tr AS (SELECT * FROM lab WHERE seq_id % 10 < 8),
    di AS (SELECT hyp, pos, substr(site, pos, 1) AS prev, substr(site, pos + 1, 1) AS base, count(*) AS n FROM (SELECT hyp, site, CAST(unnest(range(1, 11)) AS INT) AS pos FROM tr) GROUP BY ALL),
    mo AS (SELECT hyp, 0 AS pos, '-' AS prev, substr(site, 1, 1) AS base, count(*) AS n FROM tr GROUP BY ALL),
    hyps AS (SELECT DISTINCT hyp FROM tr),
    grid AS (SELECT hyp, 0 AS pos, '-' AS prev, base FROM hyps, {BASES} UNION ALL SELECT hyp, CAST(k AS INT), p.base, b.base FROM hyps, range(1, 11) r(k), {BASES} p, {BASES} b),
    cnt AS (SELECT g.*, coalesce(x.n, 0) AS n FROM grid g LEFT JOIN (SELECT * FROM di UNION ALL SELECT * FROM mo) x USING (hyp, pos, prev, base)),
    frq AS (SELECT *, coalesce(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY hyp, pos, prev), 0), 0.0) AS p FROM cnt),
    smo AS (SELECT *, {_SMOOTH} AS q FROM frq WINDOW w AS (PARTITION BY hyp, pos, prev)),
    wam AS (SELECT hyp, pos, prev, base, CAST(CASE WHEN pos = 5 THEN CASE WHEN base = 'A' THEN 1 ELSE 0 END WHEN pos = 6 THEN CASE WHEN prev = 'A' AND base = 'T' THEN 1 ELSE 0 END
        WHEN pos = 7 THEN CASE WHEN prev = 'T' AND base = 'G' THEN 1 ELSE 0 END WHEN pos = 8 AND prev <> 'G' THEN 0 ELSE q END AS DOUBLE) AS p FROM smo)"""
SCORED = f"""{WAM}, sc AS (SELECT m.seq_id, m.pos, m.len, w.hyp, sum(ln(w.p)) AS llk FROM (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM mets) m
        JOIN wam w ON w.pos = m.k AND w.base = substr(m.site, m.k + 1, 1) AND w.prev = CASE WHEN m.k = 0 THEN '-' ELSE substr(m.site, m.k, 1) END GROUP BY ALL),
    scored AS (SELECT seq_id, pos, len, max(llk) FILTER (hyp = 'T') AS llk_true, max(llk) FILTER (hyp = 'F') AS llk_false,
        round(max(llk) FILTER (hyp = 'T') - max(llk) FILTER (hyp = 'F'), 6) AS llkr FROM sc GROUP BY ALL),
    cand AS (SELECT *, CAST(len - 200 - (pos - 102) AS DOUBLE) / (len - 200) AS t FROM scored WHERE (len - 98 - pos) // 3 >= 50)"""
EXONS = f"""{CONTIGS}, it AS (SELECT l_orderkey AS gene, l_orderkey % (SELECT count(*) FROM documents) AS contig_id, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS exon_no, 10 + l_partkey % 60 AS e, 41 + l_suppkey % 50 AS i FROM lineitem),
    off AS (SELECT *, CAST(121 + coalesce(sum(e + i) OVER (PARTITION BY gene ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM it),
    exons AS (SELECT gene, contig_id, strand, exon_no, CASE WHEN strand = '-' THEN length(seq) - a + 1 ELSE a END AS start, CASE WHEN strand = '-' THEN length(seq) - (a + e - 1) + 1 ELSE a + e - 1 END AS stop
        FROM off JOIN contigs USING (contig_id))"""
INTRONS = f"""{EXONS}, introns AS (SELECT gene, contig_id, strand, exon_no AS intron_no, CASE WHEN strand = '-' THEN stop - 1 ELSE stop + 1 END AS start, CASE WHEN strand = '-' THEN nxt + 1 ELSE nxt - 1 END AS stop
    FROM (SELECT *, lead(start) OVER (PARTITION BY gene ORDER BY exon_no) AS nxt FROM exons) WHERE nxt IS NOT NULL)"""


def slice_sql(start: str, stop: str, seq: str = "c.seq", strand: str = "strand") -> str:
    """DuckDB expression of functions.seq.subseq."""
    lo, hi = f"least({start}, {stop})", f"greatest({start}, {stop})"
    cut = f"substr({seq}, CAST({lo} AS INT), CAST({hi} - {lo} + 1 AS INT))"
    return f"CASE WHEN {lo} >= 1 AND {hi} <= length({seq}) THEN CASE WHEN {strand} = '-' THEN reverse(translate({cut}, 'ACGT', 'TGCA')) ELSE {cut} END END"
