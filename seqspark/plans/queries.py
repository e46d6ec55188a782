"""One query per operator (or tight group) over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqspark.functions import seq as S
from seqspark.operators import content, kmers, sampling, sites, structure, vectors
from seqspark.plans import tables as T
from seqspark.sources import shared, xml

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
AA = S.AMINO_ACIDS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def medoids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(T.MEDOIDS, "cluster int, site string")


MEDOID_SQL = "med AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in T.MEDOIDS) + ") v(cluster, m))"
CODON_SQL = "substr('" + AA + "', 1 + 16 * (instr('TCAG', substr(c, 1, 1)) - 1) + 4 * (instr('TCAG', substr(c, 2, 1)) - 1) + instr('TCAG', substr(c, 3, 1)) - 1, 1)"
PEPTIDE_SQL = "array_to_string(list_transform(range(0, length(s) // 3), lambda i: (" + CODON_SQL.replace("c,", "substr(s, CAST(3 * i + 1 AS INT), 3),") + ")), '')"


def wam_sql(name: str, rows: str, length: int, at: int, motif: str, smooth_first: bool = True) -> str:
    """CTEs that end in name(g, pos, prev, base, p), the weight array matrices of rows(g, site)."""
    motif_p = "".join(f" WHEN pos = {at + i} THEN CASE WHEN prev = '{motif[i - 1]}' AND base = '{motif[i]}' THEN 1 ELSE 0 END" for i in range(1, len(motif)))
    return f"""{name}_gs AS (SELECT DISTINCT g FROM {rows}), {name}_cn AS (SELECT g, pos, CASE WHEN pos = 0 THEN '-' ELSE substr(site, pos, 1) END AS prev, substr(site, pos + 1, 1) AS base, count(*) AS n FROM (SELECT g, site, CAST(unnest(range(0, {length})) AS INT) AS pos FROM {rows}) GROUP BY ALL),
    {name}_gr AS (SELECT g, 0 AS pos, '-' AS prev, base FROM {name}_gs, {T.BASES} UNION ALL SELECT g, CAST(k AS INT), p.base, b.base FROM {name}_gs, range(1, {length}) r(k), {T.BASES} p, {T.BASES} b),
    {name}_fr AS (SELECT g, pos, prev, base, coalesce(CAST(coalesce(n, 0) AS DOUBLE) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g, pos, prev), 0), 0.0) AS p FROM {name}_gr LEFT JOIN {name}_cn USING (g, pos, prev, base)),
    {name}_sm AS (SELECT *, {T._SMOOTH} AS q FROM {name}_fr WINDOW w AS (PARTITION BY g, pos, prev)),
    {name} AS (SELECT g, pos, prev, base, CAST(CASE WHEN pos = 0 THEN {'q' if smooth_first else 'p'} WHEN pos = {at} THEN CASE WHEN base = '{motif[0]}' THEN 1 ELSE 0 END{motif_p} WHEN pos = {at + len(motif)} AND prev <> '{motif[-1]}' THEN 0 ELSE q END AS DOUBLE) AS p FROM {name}_sm)"""


# Sequences and columns


@query("b1_normalize_seq", f"WITH {T.CONTIGS} SELECT contig_id AS seq_id, length(seq) AS n_nt, length(seq) - length(translate(seq, 'GC', '')) AS n_gc, md5(seq) AS digest FROM contigs")
def b1(spark, d):
    rna = T.contigs(spark, d).withColumn("seq", F.lower(F.translate("seq", "T", "U")))
    seq = S.normalize_seq(F.col("seq"), "reject")
    return rna.select(F.col("contig_id").alias("seq_id"), seq.alias("s")).select("seq_id", F.length("s").cast("long").alias("n_nt"), (F.length("s") - F.length(F.translate("s", "GC", ""))).cast("long").alias("n_gc"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query("b2_revcomp", f"WITH {T.SEQS} SELECT seq_id, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM seqs")
def b2(spark, d):
    return T.seqs(spark, d).select("seq_id", F.md5(S.revcomp(F.col("seq")).cast("binary")).alias("digest"))


@query("b3_subseq", f"WITH {T.EXONS} SELECT gene, exon_no, {T.slice_sql('start', 'stop')} AS piece FROM exons JOIN contigs c USING (contig_id)")
def b3(spark, d):
    return structure.with_slices(T.exons(spark, d), T.contigs(spark, d)).select("gene", "exon_no", "piece")


@query("b4_translate_cds", f"WITH {T.SEQS}, cds AS (SELECT seq_id, substr(seq, 102, length(seq) - 200) AS s FROM seqs) SELECT seq_id, {PEPTIDE_SQL} AS peptide FROM cds")
def b4(spark, d):
    cds = F.substring("seq", F.lit(102), F.length("seq") - 200)
    return T.seqs(spark, d).select("seq_id", S.translate_cds(cds).alias("peptide"))


@query(
    "b5_six_frames",
    f"""WITH {T.SEQS}, f AS (SELECT seq_id, frame, CASE WHEN frame < 3 THEN substr(seq, frame + 1) ELSE substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1 + CAST((length(seq) % 3 + frame - 3) % 3 AS INT)) END AS s
        FROM seqs, (SELECT CAST(unnest(range(6)) AS INT) AS frame)) SELECT seq_id, frame, md5(substr(s, 1, CAST(length(s) // 3 * 3 AS INT))) AS digest, length(s) // 3 * 3 AS n FROM f""",
)
def b5(spark, d):
    n = F.length("seq")
    frame = F.col("frame")
    shift = F.when(frame < 3, frame).otherwise(F.pmod(n % 3 + frame - 3, F.lit(3))).cast("int")
    rows = T.seqs(spark, d).select("seq_id", "seq", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("frame"))
    s = F.expr("substring(x, 1, CAST(length(x) div 3 * 3 AS int))")
    rows = rows.withColumn("x", F.when(frame < 3, F.col("seq")).otherwise(S.revcomp(F.col("seq")))).withColumn("x", F.substring("x", shift + 1, n))
    return rows.select("seq_id", "frame", F.md5(s.cast("binary")).alias("digest"), F.length(s).cast("long").alias("n"))


@query(
    "b9_cds_eligible",
    f"WITH {T.CONTIGS} SELECT (length(seq) > 200 AND (length(seq) - 200) % 3 = 0) AS eligible, count(*) AS n FROM contigs GROUP BY ALL",
)
def b9(spark, d):
    return T.contigs(spark, d).groupBy(S.cds_eligible(F.length("seq")).alias("eligible")).agg(F.count("*").alias("n"))


@query(
    "b10_length_filters",
    f"WITH {T.CONTIGS} SELECT contig_id AS seq_id, length(seq) AS n FROM contigs WHERE length(seq) >= 500 AND length(seq) <= 3000",
)
def b10(spark, d):
    n = F.length("seq")
    return T.contigs(spark, d).where((n >= 500) & (n <= 3000)).select(F.col("contig_id").alias("seq_id"), n.cast("long").alias("n"))


RAW_SQL = "raw AS (SELECT doc_id AS seq_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS seq FROM documents)"


def raw(spark, d):
    return T.read(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("seq"))


@query(
    "b11_clean_and_masked",
    f"""WITH {RAW_SQL}, m AS (SELECT seq_id, seq, CASE WHEN seq_id % 3 = 0 THEN seq ELSE upper(regexp_replace(seq, '[^ACGTacgt]', '', 'g')) END AS t FROM raw)
    SELECT seq_id, regexp_matches(t, '^[ACGTacgt]+$') AND length(t) > 6 AS clean, NOT regexp_matches(t, '[^ACGTacgt]') AS unambiguous,
      round(CAST(length(regexp_replace(upper(t), '[^X]', '', 'g')) AS DOUBLE) / nullif(length(t), 0), 6) AS masked,
      length(regexp_replace(substr(t, 1, 101), '[ACGTacgt]', '', 'g')) < 10 AS flank_ok, md5(translate(t, 'acgt', 'NNNN')) AS hard FROM m""",
)
def b11(spark, d):
    t = F.when(F.col("seq_id") % 3 == 0, F.col("seq")).otherwise(F.upper(F.regexp_replace("seq", "[^ACGTacgt]", "")))
    rows = raw(spark, d).select("seq_id", t.alias("t"))
    c = F.col("t")
    return rows.select("seq_id", S.clean_training(c).alias("clean"), (~c.rlike("[^ACGTacgt]")).alias("unambiguous"), F.round(S.masked_share(c), 6).alias("masked"), S.lead_flank_ok(c).alias("flank_ok"), F.md5(S.hard_mask(c).cast("binary")).alias("hard"))


@query(
    "b15_canonical_start_stop",
    f"""WITH {T.SEQS} SELECT substr(seq, 102, 3) = 'ATG' AS met, substr(seq, 102, 3) = 'ATG' AND substr(seq, length(seq) - 101, 3) IN ('TAA', 'TAG', 'TGA') AS canonical, count(*) AS n FROM seqs GROUP BY ALL""",
)
def b15(spark, d):
    rows = T.seqs(spark, d).select(S.is_met(F.substring("seq", 102, 3)).alias("met"), S.canonical_start_stop(F.col("seq")).alias("canonical"))
    return rows.groupBy("met", "canonical").agg(F.count("*").alias("n"))


@query(
    "b15_canonical_rejects",
    f"WITH {T.SEQS} SELECT seq_id, CASE WHEN substr(seq, 102, 3) <> 'ATG' THEN 'start' WHEN substr(seq, length(seq) - 101, 3) NOT IN ('TAA', 'TAG', 'TGA') THEN 'stop' END AS reason FROM seqs",
)
def b15_rejects(spark, d):
    return T.seqs(spark, d).select("seq_id", S.canonical_reject(F.col("seq")).alias("reason"))


@query(
    "b13_masked_rejects",
    f"WITH {RAW_SQL} SELECT seq_id, CASE WHEN coalesce(length(seq), 0) = 0 THEN 'empty' WHEN length(regexp_replace(seq, '[^Xx]', '', 'g')) / length(seq) > 0.002 THEN 'masked' END AS reason FROM raw",
)
def b13_rejects(spark, d):
    return raw(spark, d).select("seq_id", S.mask_reject(F.col("seq"), 0.002).alias("reason"))


@query("b18_site_at", f"WITH {T.SEQS} SELECT substr(seq, 97, 11) AS site, count(*) AS n FROM seqs GROUP BY ALL")
def b18(spark, d):
    return T.seqs(spark, d).groupBy(S.site_at(F.col("seq")).alias("site")).agg(F.count("*").alias("n"))


@query(
    "c8_nearest_medoid",
    f"""WITH {T.SITES}, {MEDOID_SQL}, x AS (SELECT seq_id, pos, cluster, len(list_filter(range(1, 12), lambda i: substr(site, CAST(i AS INT), 1) <> substr(m, CAST(i AS INT), 1))) AS dist FROM mets, med)
    SELECT seq_id, pos, arg_min(cluster, dist * 100 + cluster) AS cluster, CAST(min(dist) AS INT) AS dist FROM x GROUP BY ALL""",
)
def c8(spark, d):
    return sites.nearest_medoid(sites.met_sites(T.seqs(spark, d)), medoids(spark)).select("seq_id", "pos", "cluster", "dist")


@query(
    "d18_cluster_error",
    f"""WITH {T.SITES}, {MEDOID_SQL}, x AS (SELECT seq_id, pos, cluster, len(list_filter(range(1, 12), lambda i: substr(site, CAST(i AS INT), 1) <> substr(m, CAST(i AS INT), 1))) AS dist FROM mets, med),
    y AS (SELECT seq_id, pos, arg_min(cluster, dist * 100 + cluster) AS cluster, min(dist) AS dist FROM x GROUP BY ALL) SELECT cluster, CAST(sum(dist) AS BIGINT) AS error, count(*) AS n FROM y GROUP BY ALL""",
)
def d18(spark, d):
    return c8(spark, d).groupBy("cluster").agg(F.sum("dist").alias("error"), F.count("*").alias("n"))


@query("e16_kmedoids")
def e16(spark, d):
    return sites.kmedoids(sites.labelled_sites(sites.met_sites(T.seqs(spark, d))).where("hyp = 'T'"), 3)


# Counts and matrices


@query("e1_true_false_sites", f"WITH {T.LABELLED} SELECT hyp, seq_id, pos, site FROM lab")
def e1(spark, d):
    return sites.labelled_sites(sites.met_sites(T.seqs(spark, d))).select("hyp", "seq_id", "pos", "site")


def training(spark, d):
    return sites.labelled_sites(sites.met_sites(T.seqs(spark, d))).where("seq_id % 10 < 8")


@query("d1_positional_counts", f"WITH {T.LABELLED} SELECT pos, substr(site, pos, 1) AS prev, substr(site, pos + 1, 1) AS base, count(*) AS n FROM (SELECT site, CAST(unnest(range(1, 11)) AS INT) AS pos FROM mets) GROUP BY ALL")
def d1(spark, d):
    return sites.count_di(sites.met_sites(T.seqs(spark, d)))


@query(
    "e3_train_pwm",
    f"""WITH {T.LABELLED}, c AS (SELECT hyp, pos, substr(site, pos + 1, 1) AS base, count(*) AS n FROM (SELECT hyp, site, CAST(unnest(range(0, 11)) AS INT) AS pos FROM lab) GROUP BY ALL),
    g AS (SELECT hyp, CAST(k AS INT) AS pos, base FROM (SELECT DISTINCT hyp FROM lab), range(0, 11) r(k), {T.BASES}),
    f AS (SELECT g.*, coalesce(CAST(coalesce(n, 0) AS DOUBLE) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY hyp, pos), 0), 0.25) AS p FROM g LEFT JOIN c USING (hyp, pos, base))
    SELECT hyp, pos, base, round(CASE WHEN pos BETWEEN 5 AND 7 THEN p ELSE {T._SMOOTH} END, 9) AS p FROM f WINDOW w AS (PARTITION BY hyp, pos)""",
)
def e3(spark, d):
    rows = sites.labelled_sites(sites.met_sites(T.seqs(spark, d)))
    return sites.train_pwm(rows, ["hyp"]).withColumn("p", F.round("p", 9))


@query("e4_train_wam", f"WITH {T.WAM} SELECT hyp, pos, prev, base, round(p, 9) AS p FROM wam")
def e4(spark, d):
    return sites.train_wam(training(spark, d), ["hyp"]).withColumn("p", F.round("p", 9))


@query("d12_verify_pmf", f"WITH {T.WAM} SELECT hyp, pos, prev, round(sum(p), 6) AS total FROM wam GROUP BY ALL HAVING abs(sum(p) - 1) > 0.0005 AND min(p) <> max(p)")
def d12(spark, d):
    return sites.verify_pmf(sites.train_wam(training(spark, d), ["hyp"]), ["hyp", "pos", "prev"]).withColumn("total", F.round("total", 6))


@query(
    "a12_model_report",
    f"WITH {T.WAM} SELECT hyp, pos, prev, " + ", ".join(f'round(max(p) FILTER (base = \'{b}\'), 4) AS "{b}"' for b in "ACGT") + " FROM wam GROUP BY ALL",
)
def a12(spark, d):
    return sites.model_report(sites.train_wam(training(spark, d), ["hyp"]), ["hyp", "pos", "prev"])


# Scores and predictions


def scored(spark, d):
    found = sites.met_sites(T.seqs(spark, d))
    return sites.with_llkr(found, sites.train_wam(training(spark, d), ["hyp"]))


@query("f2_llkr", f"WITH {T.SCORED} SELECT seq_id, pos, round(llk_true, 6) AS llk_true, round(llk_false, 6) AS llk_false, llkr FROM scored")
def f2(spark, d):
    return scored(spark, d).select("seq_id", "pos", F.round("llk_true", 6).alias("llk_true"), F.round("llk_false", 6).alias("llk_false"), "llkr")


@query(
    "f4_six_frame_scan",
    f"""WITH {T.WAM}, s AS (SELECT seq_id, '+' AS strand, seq AS s FROM seqs UNION ALL SELECT seq_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs),
    h AS (SELECT seq_id, strand, CASE WHEN strand = '+' THEN p ELSE length(s) - p + 1 END AS pos, substr(s, CAST(p AS INT) - 5, 11) AS site FROM (SELECT *, unnest(range(6, length(s) - 4)) AS p FROM s) WHERE substr(s, CAST(p AS INT), 3) = 'ATG'),
    k AS (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM h)
    SELECT strand, count(*) // 11 AS n, round(sum(CASE WHEN hyp = 'T' THEN ln(p) ELSE -ln(p) END), 3) AS total FROM k JOIN wam w ON w.pos = k.k AND w.base = substr(site, k + 1, 1) AND w.prev = CASE WHEN k = 0 THEN '-' ELSE substr(site, k, 1) END GROUP BY strand""".replace("count(*) // 11 AS n", "count(*) // 22 AS n"),
)
def f4(spark, d):
    found = sites.all_frame_sites(T.seqs(spark, d))
    rows = sites.with_llkr(found, sites.train_wam(training(spark, d), ["hyp"]))
    return rows.groupBy("strand").agg(F.count("*").alias("n"), F.round(F.sum(F.col("llk_true") - F.col("llk_false")), 3).alias("total"))


@query(
    "f4_six_frame_sites",
    f"""WITH {T.WAM}, s AS (SELECT seq_id, '+' AS strand, seq AS s FROM seqs UNION ALL SELECT seq_id, '-', reverse(translate(seq, 'ACGT', 'TGCA')) FROM seqs),
    h AS (SELECT seq_id, strand, CAST(CASE WHEN strand = '+' THEN p ELSE length(s) - p + 1 END AS INT) AS pos, substr(s, CAST(p AS INT) - 5, 11) AS site FROM (SELECT *, unnest(range(6, length(s) - 4)) AS p FROM s) WHERE substr(s, CAST(p AS INT), 3) = 'ATG'),
    k AS (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM h),
    l AS (SELECT seq_id, strand, k.pos, hyp, sum(ln(p)) AS l FROM k JOIN wam w ON w.pos = k.k AND w.base = substr(site, k + 1, 1) AND w.prev = CASE WHEN k = 0 THEN '-' ELSE substr(site, k, 1) END GROUP BY ALL)
    SELECT seq_id, strand, pos, round(max(l) FILTER (hyp = 'T') - max(l) FILTER (hyp = 'F'), 6) AS llkr FROM l GROUP BY ALL""",
)
def f4_sites(spark, d):
    rows = sites.with_llkr(sites.all_frame_sites(T.seqs(spark, d)), sites.train_wam(training(spark, d), ["hyp"]))
    return rows.select("seq_id", "strand", "pos", "llkr")


@query("f5_candidate_sites", f"WITH {T.SITES} SELECT seq_id, pos FROM mets WHERE (len - 98 - pos) // 3 >= 50")
def f5(spark, d):
    return sites.candidates(sites.met_sites(T.seqs(spark, d))).select("seq_id", "pos")


@query(
    "f10_predict_llkr",
    f"WITH {T.SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY llkr DESC, pos) AS r FROM cand) SELECT seq_id, CASE WHEN llkr >= 0 THEN pos ELSE -1 END AS tis, llkr AS score FROM b WHERE r = 1",
)
def f10(spark, d):
    return sites.predict_llkr(scored(spark, d))


@query(
    "f11_predict_wllkr",
    f"""WITH {T.SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, pos) AS r FROM (SELECT *, round(llkr + 3 * ln(t), 6) AS score FROM cand))
    SELECT seq_id, CASE WHEN llkr >= 0 THEN pos ELSE -1 END AS tis, score FROM b WHERE r = 1""",
)
def f11(spark, d):
    return sites.predict_wllkr(scored(spark, d))


@query(
    "f12_predict_bayes",
    f"""WITH {T.SCORED}, n AS (SELECT *, count(*) OVER (PARTITION BY seq_id) AS n FROM cand),
    h AS (SELECT seq_id, pos, 1 AS tr, round(ln(t / n) + llk_true, 6) AS score FROM n UNION ALL SELECT seq_id, pos, 0, CASE WHEN t < 1 THEN round(ln((1 - t) / n) + llk_false, 6) ELSE CAST('-infinity' AS DOUBLE) END FROM n),
    b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, tr DESC, pos) AS r FROM h) SELECT seq_id, CASE WHEN tr = 1 THEN pos ELSE -1 END AS tis, score FROM b WHERE r = 1""",
)
def f12(spark, d):
    return sites.predict_bayes(scored(spark, d))


@query(
    "a13_tis_report",
    f"""WITH {T.SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY llkr DESC, pos) AS r FROM cand)
    SELECT s.seq_id, coalesce(CASE WHEN llkr >= 0 THEN pos END, -1) AS tis, coalesce(llkr >= 0, false) AS predicted FROM seqs s LEFT JOIN b ON b.seq_id = s.seq_id AND r = 1""",
)
def a13(spark, d):
    best = sites.predict_llkr(scored(spark, d))
    rows = T.seqs(spark, d).select("seq_id").join(best, "seq_id", "left")
    return rows.select("seq_id", F.coalesce("tis", F.lit(-1)).alias("tis"), F.coalesce(F.col("tis") > 0, F.lit(False)).alias("predicted"))


# k-mers

KMERS_SQL = f"""{T.SEQS}, six AS (SELECT CAST(i % 3 AS INT) AS model, substr(seq, CAST(i AS INT) + 1, 6) AS h, count(*) AS n FROM (SELECT seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs) GROUP BY ALL),
    km AS (SELECT model, k, substr(h, 1, k - 1) AS hist, substr(h, k, 1) AS base, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, CAST(unnest(range(1, 7)) AS INT) AS k FROM six) GROUP BY ALL)"""


def periodic(spark, d):
    return kmers.count_kmers(T.seqs(spark, d), F.pmod(F.col("i"), F.lit(3)), period=3)


@query("d2_count_kmers", f"WITH {KMERS_SQL} SELECT k, hist, base, CAST(sum(n) AS BIGINT) AS n FROM km GROUP BY ALL")
def d2(spark, d):
    return kmers.count_kmers(T.seqs(spark, d), F.lit(3), period=1).select("k", "hist", "base", "n")


@query("d3_count_kmers_3periodic", f"WITH {KMERS_SQL} SELECT * FROM km")
def d3(spark, d):
    return periodic(spark, d)


@query("d6_relative_freq", f"WITH {KMERS_SQL} SELECT model, k, hist, base, n, round(n / sum(n) OVER (PARTITION BY model, k, hist), 9) AS ml FROM km")
def d6(spark, d):
    return kmers.relative_freq(periodic(spark, d)).withColumn("ml", F.round("ml", 9))


GRID5 = "hh AS (SELECT a.base || b.base || c.base || d.base || e.base AS hist FROM " + ", ".join(f"{T.BASES} {x}" for x in "abcde") + ")"
FIXED_SQL = f"""{KMERS_SQL}, {GRID5}, fo AS (SELECT model, hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY model, hist) AS p
    FROM (SELECT model, hist, base FROM hh, {T.BASES}, (SELECT unnest([0, 1, 2]) AS model)) LEFT JOIN (SELECT * FROM km WHERE k = 6) USING (model, hist, base))"""


@query("e5_train_fixed_order", f"WITH {FIXED_SQL} SELECT model, hist, base, round(p, 9) AS p FROM fo")
def e5(spark, d):
    return kmers.train_fixed_order(periodic(spark, d)).withColumn("p", F.round("p", 9))


@query(
    "f6_fo_loglik",
    f"""WITH {FIXED_SQL}, w AS (SELECT seq_id, i, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs)),
    x AS (SELECT seq_id, i, h, m FROM w, (SELECT unnest([0, 1, 2]) AS m)) SELECT seq_id, m AS model, round(sum(ln(p)), 4) AS loglik FROM x JOIN fo ON fo.model = (i + m) % 3 AND fo.hist = substr(h, 1, 5) AND fo.base = substr(h, 6, 1) GROUP BY ALL""",
)
def f6(spark, d):
    chain = kmers.train_fixed_order(periodic(spark, d))
    return kmers.fo_loglik(T.seqs(spark, d), chain).withColumn("loglik", F.round("loglik", 4))


#: Chi-square with three degrees of freedom below chi2, the series of kmers.chi2_confidence in logarithms.
_CONFIDENCE = "CASE WHEN chi2 <= 0 THEN 0 WHEN chi2 >= 100 THEN 1 ELSE least(1.0, list_sum(list_transform(range(0, 201), lambda i: exp((i + 1.5) * ln(chi2 / 2) - chi2 / 2 - lgamma(i + 2.5))))) END"


def _imm_sql() -> str:
    """CTEs lv1 to lv6 (model, hist, base, p): the interpolated chain, each order from the one before."""
    out = [KMERS_SQL.replace("km AS (", "km AS MATERIALIZED ("), "h0 AS (SELECT '' AS hist)", "lv1 AS MATERIALIZED (SELECT model, '' AS hist, base, n / sum(n) OVER (PARTITION BY model) AS p FROM km WHERE k = 1)"]
    for k in range(2, 7):
        out.append(f"""h{k - 1} AS (SELECT hist || base AS hist FROM h{k - 2}, {T.BASES}),
    a{k} AS (SELECT g.*, q.p AS q, CAST(sum(g.n) OVER (PARTITION BY g.model, g.hist) AS BIGINT) AS total FROM (SELECT model, hist, base, coalesce(n, 0) AS n FROM (SELECT model, hist, base FROM (SELECT DISTINCT model FROM km), h{k - 1}, {T.BASES}) LEFT JOIN (SELECT * FROM km WHERE k = {k}) USING (model, hist, base)) g
      JOIN lv{k - 1} q ON q.model = g.model AND q.hist = substr(g.hist, 2) AND q.base = g.base),
    b{k} AS (SELECT *, sum(CASE WHEN mean > 0 THEN ((n - mean) * (n - mean) + (expected - mean) * (expected - mean)) / mean ELSE 0 END) OVER w AS chi2, min(least(mean, expected)) OVER w AS low FROM (SELECT *, total * q AS expected, (n + total * q) / 2 AS mean FROM a{k}) WINDOW w AS (PARTITION BY model, hist)),
    c{k} AS (SELECT *, CASE WHEN total >= 400 THEN 1.0 WHEN low < 5 OR conf < 0.5 THEN 0.0 ELSE conf * total / 400 END AS l FROM (SELECT *, {_CONFIDENCE} AS conf FROM b{k})),
    d{k} AS (SELECT model, hist, base, total, CASE WHEN total > 0 THEN l * n / total + (1 - l) * q ELSE q END AS p, greatest(5e-5::DOUBLE, 1.0::DOUBLE / nullif(total, 0)) AS fix FROM c{k}),
    lv{k} AS MATERIALIZED (SELECT model, hist, base, CASE WHEN total > 0 AND min(p) OVER (PARTITION BY model, hist) < 1e-5 THEN CASE WHEN p < 1e-5 THEN fix ELSE p * (1 - 4 * fix) + fix END ELSE p END AS p FROM d{k})""")
    return ", ".join(out)


IMM_SQL = _imm_sql()


@query("e6_train_chi2_imm", f"WITH {IMM_SQL} " + " UNION ALL ".join(f"SELECT model, {k} AS k, hist, base, round(p, 9) AS p FROM lv{k}" for k in range(1, 7)))
def e6(spark, d):
    return kmers.train_chi2_imm(periodic(spark, d)).withColumn("p", F.round("p", 9))


def split_counts(spark, d):
    """Counts of parts 0 to 8 for training and of part 9 held out."""
    seqs = T.seqs(spark, d).withColumn("part", sampling.partition_of(F.col("seq_id"), 10))
    return [kmers.count_kmers(seqs.where(c), F.pmod(F.col("i"), F.lit(3)), period=3) for c in ("part < 9", "part = 9")]


@query("e8_train_top_down")
def e8(spark, d):
    return kmers.train_deleted_interpolation(*split_counts(spark, d)).withColumn("p", F.round("p", 9))


@query("e9_train_bottom_up")
def e9(spark, d):
    return kmers.train_deleted_interpolation(*split_counts(spark, d), top_down=False).withColumn("p", F.round("p", 9))


CLASSIFIED_SQL = f"""{FIXED_SQL}, nsix AS (SELECT substr(s, CAST(i AS INT) + 1, 6) AS h, count(*) AS n FROM (SELECT s, unnest(range(0, length(s) - 5)) AS i FROM (SELECT reverse(translate(seq, 'ACGT', 'TGCA')) AS s FROM seqs)) GROUP BY ALL),
    nfo AS (SELECT hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY hist) AS p FROM (SELECT hist, base FROM hh, {T.BASES}) LEFT JOIN (SELECT substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, n FROM nsix) USING (hist, base)),
    w AS MATERIALIZED (SELECT seq_id, i, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs)),
    lg AS (SELECT seq_id, m AS model, sum(ln(p)) AS l FROM (SELECT * FROM w, (SELECT unnest([0, 1, 2]) AS m)) JOIN fo ON fo.model = (i + m) % 3 AND fo.hist = substr(h, 1, 5) AND fo.base = substr(h, 6, 1) GROUP BY ALL
      UNION ALL SELECT seq_id, 3, sum(ln(p)) FROM w JOIN nfo ON nfo.hist = substr(h, 1, 5) AND nfo.base = substr(h, 6, 1) GROUP BY ALL),
    pw AS (SELECT seq_id, model, l + ln(CASE WHEN model = 3 THEN 0.5 ELSE 1.0::DOUBLE / 6 END) AS x FROM lg), pe AS (SELECT *, exp(x - max(x) OVER (PARTITION BY seq_id)) AS e FROM pw),
    pp AS (SELECT seq_id, model, round(e / sum(e) OVER (PARTITION BY seq_id), 6) AS posterior FROM pe), cl AS (SELECT seq_id, model AS best, posterior FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY posterior DESC, model) AS r FROM pp) WHERE r = 1)"""


@query("f19_classify_coding", f"WITH {CLASSIFIED_SQL} SELECT seq_id, best, posterior FROM cl")
def f19(spark, d):
    chain = kmers.train_fixed_order(periodic(spark, d))
    noncoding = kmers.train_fixed_order(kmers.count_kmers(T.seqs(spark, d).withColumn("seq", S.revcomp(F.col("seq"))), F.lit(3), period=1))
    return kmers.classify_coding(T.seqs(spark, d), chain, noncoding)


@query(
    "d16_gc_histogram",
    f"""WITH {T.CONTIGS}, w AS (SELECT length(s) - length(translate(s, 'GC', '')) AS gc FROM (SELECT substr(seq, CAST(p AS INT), 100) AS s FROM (SELECT seq, unnest(range(1, length(seq) - 98)) AS p FROM contigs WHERE length(seq) >= 100))
    UNION ALL SELECT 100 * (length(seq) - length(translate(seq, 'GC', ''))) // length(seq) FROM contigs WHERE length(seq) BETWEEN 1 AND 99) SELECT CAST(gc AS INT) AS gc, count(*) AS n FROM w GROUP BY ALL""",
)
def d16(spark, d):
    return kmers.gc_windows(T.contigs(spark, d))


@query(
    "d11_partition_stats",
    f"""WITH {T.SEQS}, c AS (SELECT part, b, count(*) AS n FROM (SELECT CAST(('0x' || substr(md5(CAST(seq_id AS VARCHAR) || 's'), 1, 8)) AS BIGINT) % 10 AS part, substr(seq, CAST(i AS INT), 1) AS b FROM (SELECT seq_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM seqs)) GROUP BY ALL),
    p AS (SELECT part, b, n / sum(n) OVER (PARTITION BY part) AS p FROM c) SELECT b AS base, round(avg(p), 9) AS mean, round(stddev_pop(p), 9) AS sd, round(min(p), 9) AS lo_rng, round(max(p), 9) AS hi_rng,
    round(least(greatest(avg(p) - stddev_pop(p), 1e-5), 1 - 1e-5), 9) AS lo_var, round(least(greatest(avg(p) + stddev_pop(p), 1e-5), 1 - 1e-5), 9) AS hi_var FROM p GROUP BY b""",
)
def d11(spark, d):
    counts = T.seqs(spark, d).select(sampling.partition_of(F.col("seq_id"), 10).alias("part"), F.explode(F.split("seq", "")).alias("base")).where("base <> ''").groupBy("part", "base").agg(F.count("*").alias("n"))
    rows = kmers.partition_stats(counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("part"))), ["base"])
    return rows.select("base", *(F.round(c, 9).alias(c) for c in rows.columns if c != "base"))


# Structures


@query("g2_introns", f"WITH {T.INTRONS} SELECT gene, intron_no, start, stop FROM introns")
def g2(spark, d):
    return structure.introns(T.exons(spark, d)).select("gene", "intron_no", "start", "stop")


@query(
    "g1_exon_phase",
    f"WITH {T.EXONS} SELECT gene, exon_no, CAST(coalesce(sum(l) OVER w, 0) % 3 AS INT) AS phase, CAST((coalesce(sum(l) OVER w, 0) + l) % 3 AS INT) AS after FROM (SELECT *, abs(stop - start) + 1 AS l FROM exons) WINDOW w AS (PARTITION BY gene ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def g1(spark, d):
    return structure.exon_phase(T.exons(spark, d)).select("gene", "exon_no", "phase", "after")


@query("d9_cds_length", f"WITH {T.EXONS} SELECT gene, CAST(sum(abs(stop - start) + 1) AS BIGINT) AS cds_length FROM exons GROUP BY ALL")
def d9(spark, d):
    return structure.cds_length(T.exons(spark, d))


@query(
    "g5_structure_ordered",
    f"WITH {T.EXONS} SELECT gene, bool_and(((stop - start) * s >= 0) AND coalesce((start - prv) * s, 1) > 0) AS ok FROM (SELECT *, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS s, lag(stop) OVER (PARTITION BY gene ORDER BY exon_no) AS prv FROM exons) GROUP BY ALL",
)
def g5(spark, d):
    return structure.structure_ordered(structure.ordered(T.exons(spark, d).drop("exon_no")))


SPLICE = "SELECT gene, md5(string_agg(piece, '' ORDER BY exon_no)) AS digest, CAST(sum(length(piece)) AS BIGINT) AS n FROM p GROUP BY gene HAVING count(piece) = count(*)"


@query("c1_splice", f"WITH {T.EXONS}, p AS (SELECT gene, exon_no, {T.slice_sql('start', 'stop')} AS piece FROM exons JOIN contigs c USING (contig_id)) {SPLICE}")
def c1(spark, d):
    return structure.splice(T.exons(spark, d), T.contigs(spark, d)).select("gene", F.md5(F.col("seq").cast("binary")).alias("digest"), F.length("seq").cast("long").alias("n"))


@query(
    "c2_splice_with_flanks",
    f"""WITH {T.EXONS}, x AS (SELECT *, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS s, exon_no = min(exon_no) OVER (PARTITION BY gene) AS f, exon_no = max(exon_no) OVER (PARTITION BY gene) AS l FROM exons),
    y AS (SELECT gene, contig_id, strand, exon_no, CASE WHEN f THEN start - 101 * s ELSE start END AS start, CASE WHEN l THEN stop + 99 * s ELSE stop END AS stop FROM x),
    p AS (SELECT gene, exon_no, {T.slice_sql('start', 'stop')} AS piece FROM y JOIN contigs c USING (contig_id)) {SPLICE}""",
)
def c2(spark, d):
    rows = structure.splice(structure.with_flanks(T.exons(spark, d)), T.contigs(spark, d))
    return rows.select("gene", F.md5(F.col("seq").cast("binary")).alias("digest"), F.length("seq").cast("long").alias("n"))


@query(
    "g3_trim_structure",
    f"""WITH {T.EXONS}, x AS (SELECT *, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS s, abs(stop - start) + 1 AS l FROM exons),
    y AS (SELECT *, CAST(coalesce(sum(l) OVER (PARTITION BY gene ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t FROM x),
    z AS (SELECT *, greatest(30 - t, 0) AS lo, least(30 + 90 - t, l) - 1 AS hi FROM y) SELECT gene, exon_no, start + s * lo AS start, start + s * hi AS stop FROM z WHERE lo <= hi""",
)
def g3(spark, d):
    return structure.trim_structure(T.exons(spark, d), 30, 90).select("gene", "exon_no", "start", "stop")


@query(
    "f23_hints",
    f"""WITH {T.INTRONS} SELECT gene, 'CDSpart' AS feature, CASE WHEN lo + 15 > hi - 15 THEN (lo + hi) // 2 ELSE lo + 15 END AS start, CASE WHEN lo + 15 > hi - 15 THEN (lo + hi) // 2 ELSE hi - 15 END AS stop
    FROM (SELECT gene, least(start, stop) AS lo, greatest(start, stop) AS hi FROM exons) UNION ALL SELECT gene, 'intronpart', least(start, stop), greatest(start, stop) FROM introns WHERE abs(stop - start) + 1 BETWEEN 41 AND 350000""",
)
def f23(spark, d):
    return structure.hints(T.exons(spark, d))


ANCHOR_SQL = f"""{T.INTRONS}, xe AS (SELECT *, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS s, max(exon_no) OVER (PARTITION BY gene) AS last FROM (SELECT e.*, {T.slice_sql('start', 'stop')} AS piece FROM exons e JOIN contigs c USING (contig_id))),
    xi AS (SELECT *, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS s FROM (SELECT i.*, {T.slice_sql('start', 'stop')} AS piece FROM introns i JOIN contigs c USING (contig_id) WHERE abs(stop - start) >= 3)),
    anchors AS (SELECT gene, exon_no * 10 AS ord, 'exonpart' AS feature, start, stop FROM xe WHERE piece IS NOT NULL
      UNION ALL SELECT gene, exon_no * 10 + 1, 'start', start, start + 2 * s FROM xe WHERE exon_no = 1 AND left(piece, 3) = 'ATG' UNION ALL SELECT gene, exon_no * 10 + 2, 'stop', stop - 2 * s, stop FROM xe WHERE exon_no = last AND right(piece, 3) IN ('TAA', 'TAG', 'TGA')
      UNION ALL SELECT gene, intron_no * 10 + 3, 'intronpart', start, stop FROM xi WHERE piece IS NOT NULL UNION ALL SELECT gene, intron_no * 10 + 4, 'dss', start, start + s FROM xi WHERE left(piece, 2) = 'GT'
      UNION ALL SELECT gene, intron_no * 10 + 5, 'ass', stop - s, stop FROM xi WHERE right(piece, 2) = 'AG')"""


@query("f24_anchors", f"WITH {ANCHOR_SQL} SELECT gene, CAST(ord AS INT) AS ord, feature, start, stop FROM anchors")
def f24(spark, d):
    return structure.anchors(T.exons(spark, d), T.contigs(spark, d))


@query("d13_gene_grammar", f"WITH {ANCHOR_SQL} SELECT gene, regexp_matches(string_agg(feature, ',' ORDER BY ord, feature), '{structure.GRAMMAR}') AS ok FROM anchors GROUP BY gene")
def d13(spark, d):
    return structure.gene_grammar_ok(f24(spark, d))


SITE_SQL = f"""{T.INTRONS}, gi AS (SELECT *, CASE WHEN strand = '-' THEN -1 ELSE 1 END AS s FROM (SELECT i.*, {T.slice_sql('start', 'stop')} AS piece FROM introns i JOIN contigs c USING (contig_id) WHERE abs(stop - start) >= 3) WHERE left(piece, 2) = 'GT' AND right(piece, 2) = 'AG'),
    ge AS (SELECT gene, contig_id, strand, intron_no, 'donor' AS terminal, start - 50 * s AS a, start + 51 * s AS b FROM gi UNION ALL SELECT gene, contig_id, strand, intron_no, 'acceptor', stop - 51 * s, stop + 50 * s FROM gi)"""


@query("e17_true_splice_sites", f"WITH {SITE_SQL} SELECT * FROM (SELECT gene, intron_no, terminal, {T.slice_sql('a', 'b')} AS site FROM ge JOIN contigs c USING (contig_id)) WHERE site IS NOT NULL")
def e17(spark, d):
    return structure.splice_sites(T.exons(spark, d), T.contigs(spark, d))


FALSE_SITE_SQL = f"""{SITE_SQL}, fp AS (SELECT gene, contig_id, strand, 'F' || CAST(coalesce(sum(abs(stop - start) + 1) OVER (PARTITION BY gene ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3 AS INT) AS kind, exon_no AS part, start, stop FROM exons
      UNION ALL SELECT gene, contig_id, strand, 'Fi', intron_no, start, stop FROM introns WHERE abs(stop - start) >= 3),
    fq AS (SELECT gene, kind, part, strand, seq, abs(stop - start) + 1 AS n, CASE WHEN strand = '-' THEN length(seq) - start + 1 ELSE start END AS p, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS s FROM fp JOIN contigs USING (contig_id) WHERE least(start, stop) >= 1 AND greatest(start, stop) <= length(seq)),
    fw AS (SELECT gene, kind, part, n, CAST(unnest(range(0, n - 1)) AS INT) AS place, p, s FROM fq), fd AS (SELECT *, substr(s, CAST(p + place AS INT), 2) AS two, substr(s, CAST(p + place - 50 AS INT), 102) AS site FROM fw WHERE p + place - 50 >= 1 AND p + place + 51 <= length(s)),
    fs AS (SELECT gene, CASE WHEN two = 'GT' THEN 'donor' ELSE 'acceptor' END AS terminal, kind, part, place, site FROM fd WHERE (two = 'GT' AND NOT (kind = 'Fi' AND place = 0)) OR (two = 'AG' AND NOT (kind = 'Fi' AND place = n - 2)))"""


@query(
    "e20_train_bssm",
    f"""WITH {FALSE_SITE_SQL}, ts AS (SELECT terminal, 'T' AS g, site FROM (SELECT terminal, {T.slice_sql('a', 'b')} AS site FROM ge JOIN contigs c USING (contig_id)) WHERE site IS NOT NULL UNION ALL SELECT terminal, kind, site FROM fs), td AS (SELECT g, site FROM ts WHERE terminal = 'donor'), ta AS (SELECT g, site FROM ts WHERE terminal = 'acceptor'),
    {wam_sql('wd', 'td', 102, 50, 'GT', False)}, {wam_sql('wa', 'ta', 102, 50, 'AG', False)} SELECT terminal, g AS hyp, pos, prev, base, round(p, 9) AS p FROM (SELECT 'donor' AS terminal, * FROM wd UNION ALL SELECT 'acceptor', * FROM wa)""",
)
def e20(spark, d):
    """One matrix for each terminal and hypothesis: true sites, and false ones by kind."""
    exons, contigs = T.exons(spark, d), T.contigs(spark, d)
    rows = structure.splice_sites(exons, contigs).select("terminal", F.lit("T").alias("hyp"), "site")
    rows = rows.union(structure.false_splice_sites(exons, contigs).select("terminal", "kind", "site"))
    motif = F.when(F.col("terminal") == "donor", "GT").otherwise("AG")
    return sites.train_wam(rows, ["terminal", "hyp"], 102, 50, motif, smooth_first=False, motif_size=2).withColumn("p", F.round("p", 9))


@query(
    "e18_false_splice_sites",
    f"WITH {FALSE_SITE_SQL} SELECT gene, terminal, kind, count(*) AS n, md5(string_agg(site, ',' ORDER BY part, place)) AS digest FROM fs GROUP BY ALL",
)
def e18(spark, d):
    return structure.false_site_digests(T.exons(spark, d), T.contigs(spark, d))


@query("e19_phase_relabel", ORACLE["g1_exon_phase"].replace("SELECT gene, exon_no, CAST(", "SELECT gene, exon_no, CAST((1 + ").replace(" % 3 AS INT) AS phase, CAST((coalesce(sum(l) OVER w, 0) + l) % 3 AS INT) AS after", ") % 3 AS INT) AS label"))
def e19(spark, d):
    return structure.exon_phase(T.exons(spark, d)).select("gene", "exon_no", structure.phase_relabel(F.col("phase")).alias("label"))


@query(
    "d10_longest_orf",
    f"""WITH {T.SEQS}, cds AS (SELECT seq_id, substr(seq, 102, length(seq) - 200) AS s FROM seqs), pep AS (SELECT seq_id, {PEPTIDE_SQL} AS peptide FROM cds),
    x AS (SELECT seq_id, string_split(peptide, '-') AS parts FROM pep), y AS (SELECT seq_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM x),
    z AS (SELECT seq_id, parts[k] AS piece, CAST(k - 1 + coalesce(list_sum(list_transform(parts[1:k-1], lambda q: length(q))), 0) AS INT) AS begin_at, row_number() OVER (PARTITION BY seq_id ORDER BY length(parts[k]) DESC, k) AS r FROM y) SELECT seq_id, piece, begin_at FROM z WHERE r = 1""",
)
def d10(spark, d):
    return structure.longest_orf(b4(spark, d), "seq_id")


@query("d7_dedupe_sequences", f"WITH {T.CONTIGS} SELECT md5(seq) AS digest, string_agg(CAST(contig_id AS VARCHAR), ' AND ' ORDER BY CAST(contig_id AS VARCHAR) DESC) AS descr FROM contigs GROUP BY seq")
def d7(spark, d):
    rows = structure.dedupe_sequences(T.contigs(spark, d).select("seq", F.col("contig_id").cast("string").alias("descr")))
    return rows.select(F.md5(F.col("seq").cast("binary")).alias("digest"), "descr")


@query("d7_sequence_classes", f"WITH {T.CONTIGS} SELECT contig_id, min(contig_id) OVER (PARTITION BY seq) AS first, count(*) OVER (PARTITION BY seq) AS copies FROM contigs")
def d7_classes(spark, d):
    rows = structure.sequence_classes(T.contigs(spark, d).withColumnRenamed("contig_id", "descr"))
    return rows.withColumnRenamed("descr", "contig_id")


# Sampling and sets


@query("h3_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || 's'), doc_id LIMIT 50")
def h3(spark, d):
    return sampling.sample_without_replacement(T.read(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query(
    "h4_balance",
    "WITH x AS (SELECT doc_id, lang, toxic = 1 AS pos FROM documents JOIN labels USING (doc_id)) SELECT doc_id, lang, pos FROM (SELECT *, count(*) FILTER (pos) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang, pos ORDER BY md5(CAST(doc_id AS VARCHAR) || 's'), doc_id) AS r FROM x) WHERE pos OR r <= n",
)
def h4(spark, d):
    rows = T.read(spark, d, "documents").select("doc_id", "lang").join(T.read(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("pos")), "doc_id")
    return sampling.balance(rows, "pos", "doc_id", "lang")


@query("h5_partition", "SELECT doc_id, CAST(CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || 's'), 1, 8)) AS BIGINT) % 10 AS INT) AS part FROM documents")
def h5(spark, d):
    return T.read(spark, d, "documents").select("doc_id", sampling.partition_of(F.col("doc_id"), 10).alias("part"))


@query("h7_difference", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def h7(spark, d):
    return T.read(spark, d, "documents").select("doc_id").exceptAll(T.read(spark, d, "labels").select("doc_id"))


@query("h8_intersect_count", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def h8(spark, d):
    return T.read(spark, d, "documents").select("doc_id").intersect(T.read(spark, d, "labels").select("doc_id")).agg(F.count("*").alias("n"))


@query("c3_extract_by_id", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def c3(spark, d):
    found, _ = sampling.extract_by_id(T.read(spark, d, "documents").select("doc_id", "lang"), T.read(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return found


@query(
    "v3_cluster_distance",
    "WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, k, avg(v) AS m FROM x GROUP BY ALL) SELECT a.label AS a, b.label AS b, round(avg((a.m - b.m) * (a.m - b.m)), 6) AS dist FROM m a JOIN m b ON a.k = b.k AND a.label < b.label GROUP BY ALL",
)
def v3(spark, d):
    means = vectors.cluster_means(T.read(spark, d, "embeddings").select("label", "embedding"), "label", "embedding")
    return vectors.mean_distances(means, "label").withColumn("dist", F.round("dist", 6))


_PAIR = "list_sum(list_transform(range(1, len(x) + 1), lambda i: {}))"
_RANK = "list_transform({0}, lambda v: len(list_filter({0}, lambda w: w < v)) + (len(list_filter({0}, lambda w: w = v)) + 1) / 2.0)"


def _correlation_sql(x: str, y: str) -> str:
    of = lambda e: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {e}))"
    u, v = f"({x}[i] - list_avg({x}))", f"({y}[i] - list_avg({y}))"
    return f"1 - {of(f'{u} * {v}')} / sqrt({of(f'{u} * {u}')} * {of(f'{v} * {v}')})"


@query(
    "v1_distances",
    f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), m AS (SELECT label, list(m ORDER BY k) AS y FROM (SELECT label, k, avg(v) AS m FROM (SELECT label, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS v FROM e) GROUP BY ALL) GROUP BY ALL),
    p AS (SELECT vec_id, x, y, {_RANK.format('x')} AS rx, {_RANK.format('y')} AS ry FROM e JOIN m USING (label))
    SELECT vec_id, round({_PAIR.format('(x[i] - y[i]) * (x[i] - y[i])')} / len(x), 6) AS euclid, round({_PAIR.format('abs(x[i] - y[i])')} / len(x), 6) AS cityblock, round({_correlation_sql('x', 'y')}, 6) AS correlation,
      round(1 - {_PAIR.format('x[i] * y[i]')} / sqrt({_PAIR.format('x[i] * x[i]')} * {_PAIR.format('y[i] * y[i]')}), 6) AS uncentred, round({_correlation_sql('rx', 'ry')}, 6) AS spearman,
      round(1 - list_sum(list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(range(1, len(x) + 1), lambda j: sign(x[i] - x[j]) * sign(y[i] - y[j]))))) / (len(x) * (len(x) - 1)), 6) AS kendall FROM p""",
)
def v1(spark, d):
    """Every vector and the mean of its label under six metrics."""
    rows = T.read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    means = vectors.cluster_means(rows, "label", "x").select("label", F.col("mean").alias("y"))
    names = {"euclid": "euclid", "cityblock": "cityblock", "correlation": "correlation", "uncentred correlation": "uncentred", "spearman": "spearman", "kendall": "kendall"}
    return rows.join(means, "label").select("vec_id", *(F.round(vectors.distance(F.col("x"), F.col("y"), m), 6).alias(n) for m, n in names.items()))


@query("v2_kmeans")
def v2(spark, d):
    placed, _ = vectors.kmeans(T.read(spark, d, "embeddings"), "vec_id", "embedding", 8)
    return placed.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum("dist"), 6).alias("dist"))


@query("v5_singular_values")
def v5(spark, d):
    return vectors.singular_values(T.read(spark, d, "embeddings"), "embedding").select("k", F.round("value", 6).alias("value"))


@query("v5_squares", "SELECT round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS squares FROM embeddings")
def v5_squares(spark, d):
    """The squares of the singular values sum to those of all components."""
    values = vectors.singular_values(T.read(spark, d, "embeddings"), "embedding")
    return values.agg(F.round(F.sum(F.col("value") * F.col("value")), 4).alias("squares"))


# Content scores, clusters, reading frames


@query("d4_shadow_counts", f"""WITH {T.SEQS}, r AS (SELECT reverse(translate(seq, 'ACGT', 'TGCA')) AS s FROM seqs),
    six AS (SELECT 3 + CAST((i + (3 - length(s) % 3) % 3) % 3 AS INT) AS model, substr(s, CAST(i AS INT) + 1, 6) AS h, count(*) AS n FROM (SELECT s, unnest(range(0, length(s) - 5)) AS i FROM r) GROUP BY ALL)
    SELECT model, k, substr(h, 1, k - 1) AS hist, substr(h, k, 1) AS base, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, CAST(unnest(range(1, 7)) AS INT) AS k FROM six) GROUP BY ALL""")  # fmt: skip
def d4(spark, d):
    return content.count_kmers_shadow(T.seqs(spark, d))


FLANK_SQL = f"""{FIXED_SQL}, fm AS (SELECT seq_id, pos, substr(seq, pos - 101, 96) AS up, substr(seq, pos + 6, 96) AS down FROM
      (SELECT seq_id, seq, CAST(unnest(range(102, length(seq) - 100, 3)) AS INT) AS pos FROM seqs) WHERE substr(seq, pos, 3) = 'ATG' AND pos - 101 >= 1 AND pos + 101 <= length(seq)),
    fl AS (SELECT seq_id, pos, 'up' AS side, up AS s FROM fm UNION ALL SELECT seq_id, pos, 'down', down FROM fm), fx AS (SELECT seq_id, pos, side, s, CAST(unnest(range(0, 91)) AS INT) AS i FROM fl),
    fs AS (SELECT seq_id, pos, side, m, sum(ln(p)) AS l FROM fx, (SELECT unnest([0, 1, 2]) AS m) JOIN fo ON fo.model = (i + m) % 3 AND fo.hist = substr(s, i + 1, 5) AND fo.base = substr(s, i + 6, 1) GROUP BY ALL),
    fp AS (SELECT seq_id, pos, side, sum(exp(l - t)) / 6 AS c, max(exp(l - t)) FILTER (m = 0) / 2 AS z FROM (SELECT *, max(l) OVER (PARTITION BY seq_id, pos, side) AS t FROM fs) GROUP BY ALL),
    fq AS (SELECT seq_id, pos, max(c / (c + z)) FILTER (side = 'up') AS post_up, max(c / (c + z)) FILTER (side = 'down') AS post_down FROM fp GROUP BY ALL)"""


@query("f9_flank_posterior", f"WITH {FLANK_SQL} SELECT seq_id, pos, round(post_up, 6) AS post_up, round(post_down, 6) AS post_down, round(ln(post_down / post_up), 6) AS mcratio FROM fq")
def f9(spark, d):
    rows = content.flank_posteriors(content.flanked_sites(T.seqs(spark, d)), kmers.train_fixed_order(periodic(spark, d)))
    return rows.select("seq_id", "pos", F.round("post_up", 6).alias("post_up"), F.round("post_down", 6).alias("post_down"), "mcratio")


SEVEN_SQL = f"""{FIXED_SQL}, sh AS (SELECT 3 + CAST((i + (3 - length(s) % 3) % 3) % 3 AS INT) AS model, substr(s, CAST(i AS INT) + 1, 6) AS h, count(*) AS n
      FROM (SELECT s, unnest(range(0, length(s) - 5)) AS i FROM (SELECT reverse(translate(seq, 'ACGT', 'TGCA')) AS s FROM seqs)) GROUP BY ALL
      UNION ALL SELECT 6, substr(s, CAST(i AS INT) + 1, 6), count(*) FROM (SELECT s, unnest(range(0, length(s) - 5)) AS i FROM (SELECT reverse(seq) AS s FROM seqs)) GROUP BY ALL),
    ch AS MATERIALIZED (SELECT model, hist, base, p FROM fo UNION ALL SELECT model, hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY model, hist) FROM
      (SELECT model, hist, base FROM hh, {T.BASES}, (SELECT unnest([3, 4, 5, 6]) AS model)) LEFT JOIN (SELECT model, substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, n FROM sh) USING (model, hist, base)),
    sw AS (SELECT seq_id, i, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs)),
    s7 AS (SELECT seq_id, m AS model, sum(ln(p)) AS loglik FROM (SELECT *, CASE WHEN m = 6 THEN 6 ELSE m // 3 * 3 + (i + m) % 3 END AS t FROM sw, (SELECT unnest(range(0, 7)) AS m)) JOIN ch ON ch.model = t AND ch.hist = substr(h, 1, 5) AND ch.base = substr(h, 6, 1) GROUP BY ALL),
    w7 AS (SELECT seq_id, model, loglik + ln(CASE WHEN model = 6 THEN 0.5 ELSE 1.0::DOUBLE / 12 END) AS w FROM s7), e7 AS (SELECT *, exp(w - max(w) OVER (PARTITION BY seq_id)) AS e FROM w7),
    p7 AS (SELECT seq_id, model, e / sum(e) OVER (PARTITION BY seq_id) AS posterior FROM e7)"""


def seven_models(spark, d):
    """Chains of both strands and of noncoding sequence, for which reversed sequences stand."""
    seqs = T.seqs(spark, d)
    noncoding = kmers.count_kmers(seqs.select(F.reverse("seq").alias("seq")), F.lit(kmers.BOTH_NONCODING), period=1)
    return kmers.train_fixed_order(periodic(spark, d).union(content.count_kmers_shadow(seqs)).union(noncoding))


@query("f21_seven_model_loglik", f"WITH {SEVEN_SQL} SELECT seq_id, CAST(model AS INT) AS model, round(loglik, 4) AS loglik FROM s7")
def f21_loglik(spark, d):
    return kmers.both_strand_loglik(T.seqs(spark, d), seven_models(spark, d)).withColumn("loglik", F.round("loglik", 4))


@query(
    "f21_coding_call",
    f"""WITH {SEVEN_SQL} SELECT seq_id, sum(posterior) FILTER (model <> 6) > 0.5 AS coding, round(sum(posterior) FILTER (model <> 6), 6) AS p_coding,
      CAST(arg_max(model, 10 * round(posterior, 6) - model / 1e8) AS INT) AS best FROM p7 GROUP BY ALL""",
)
def f21(spark, d):
    logs = kmers.both_strand_loglik(T.seqs(spark, d), seven_models(spark, d))
    called = kmers.coding_call(kmers.posteriors(logs, kmers.BOTH_NONCODING), noncoding=kmers.BOTH_NONCODING)
    return called.withColumn("p_coding", F.round("p_coding", 6))


def content_scored(spark, d):
    wam = sites.train_wam(training(spark, d), ["hyp"])
    flanked = content.flank_posteriors(content.flanked_sites(T.seqs(spark, d)), kmers.train_fixed_order(periodic(spark, d)))
    return sites.with_llkr(flanked, wam)


CONTENT_SQL = f"""{T.SCORED}{FLANK_SQL[len(T.SEQS):]}, cs AS (SELECT s.seq_id, s.pos, s.len, s.llkr, s.llkr + 3 * ln(CAST(s.len - 200 - (s.pos - 102) AS DOUBLE) / (s.len - 200)) AS x, round(ln(post_down / post_up), 6) AS y FROM scored s JOIN fq USING (seq_id, pos))"""


def solve_sql(rows: str) -> str:
    """CTEs that end in nw(w0, w1, w2), the least-squares solution over rows(x, y, t) by Cramer's rule."""
    det = lambda a: f"({a[0]} * ({a[4]} * {a[8]} - {a[5]} * {a[7]}) - {a[1]} * ({a[3]} * {a[8]} - {a[5]} * {a[6]}) + {a[2]} * ({a[3]} * {a[7]} - {a[4]} * {a[6]}))"
    m, t = ["n", "sx", "sy", "sx", "sxx", "sxy", "sy", "sxy", "syy"], ["st", "sxt", "syt"]
    own = [", ".join(f"{det([t[i // 3] if i % 3 == k else v for i, v in enumerate(m)])} / {det(m)} AS w{k}" for k in range(3))]
    return f"""mo9 AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy, sum(t) AS st, sum(x * t) AS sxt, sum(y * t) AS syt FROM {rows}), nw AS (SELECT {own[0]} FROM mo9)"""


@query("e13_features", f"WITH {CONTENT_SQL} SELECT cs.seq_id, cs.pos, hyp, round(x, 6) AS site_ratio, y AS mcratio FROM cs JOIN lab USING (seq_id, pos)")
def e13(spark, d):
    """Weighted log-likelihood ratio and content ratio of every labelled site with whole flanks."""
    rows = content_scored(spark, d).withColumn("site_ratio", F.round(F.col("llkr") + 3 * F.log(sites.position_weight()), 6)).select("seq_id", "pos", "site_ratio", "mcratio")
    labels = sites.labelled_sites(sites.met_sites(T.seqs(spark, d))).select("seq_id", "pos", "hyp")
    return labels.join(rows, ["seq_id", "pos"]).select("seq_id", "pos", "hyp", "site_ratio", "mcratio")


def neuron_rows(spark, d):
    rows = e13(spark, d).where("site_ratio IS NOT NULL AND mcratio IS NOT NULL")
    return rows.select(F.col("site_ratio").alias("x"), F.col("mcratio").alias("y"), F.when(F.col("hyp") == "T", 1.0).otherwise(-1.0).alias("target"))


def rounded(weights: DataFrame) -> DataFrame:
    return weights.select(*(F.round(f"w{k}", 6).alias(f"w{k}") for k in range(3)))


@query(
    "e14_linear_unit",
    f"""WITH {CONTENT_SQL}, nr AS (SELECT round(x, 6) AS x, y, CASE WHEN hyp = 'T' THEN 1.0::DOUBLE ELSE -1.0 END AS t FROM cs JOIN lab USING (seq_id, pos) WHERE x IS NOT NULL AND y IS NOT NULL),
    {solve_sql('nr')} SELECT round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM nw""",
)
def e14(spark, d):
    return rounded(sites.linear_unit(neuron_rows(spark, d)))


@query("e15_sigmoid_unit")
def e15(spark, d):
    return sites.sigmoid_unit(neuron_rows(spark, d).withColumn("target", (F.col("target") > 0).cast("double")))


@query(
    "f13_predict_mfcwllkr",
    f"""WITH {CONTENT_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY v DESC, pos) AS r FROM (SELECT seq_id, pos, round(x + y, 6) AS v FROM cs WHERE (len - 98 - pos) // 3 >= 50 AND x IS NOT NULL))
    SELECT seq_id, CASE WHEN v >= 0 THEN pos ELSE -1 END AS tis, v AS score FROM b WHERE r = 1""",
)
def f13(spark, d):
    return content.predict_content(content_scored(spark, d))


@query(
    "f14_predict_nfcwllkr",
    f"""WITH {CONTENT_SQL}, fr AS (SELECT *, pos = min(pos) OVER (PARTITION BY seq_id) AS first FROM cs), nr AS (SELECT x, y, CASE WHEN first THEN 1.0::DOUBLE ELSE -1.0 END AS t FROM fr WHERE x IS NOT NULL AND seq_id % 10 < 8),
    {solve_sql('nr')}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY v DESC, pos) AS r FROM (SELECT seq_id, pos, round(w0 + w1 * x + w2 * y, 6) AS v FROM cs, nw WHERE (len - 98 - pos) // 3 >= 50 AND x IS NOT NULL))
    SELECT seq_id, CASE WHEN v > 0 THEN pos ELSE -1 END AS tis, v AS score FROM b WHERE r = 1""",
)
def f14(spark, d):
    rows = content_scored(spark, d)
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("seq_id"))
    fed = rows.withColumn("first", first).withColumn("x", F.col("llkr") + 3 * F.log(sites.position_weight())).where("x IS NOT NULL AND seq_id % 10 < 8")
    neuron = sites.linear_unit(fed.select("x", F.col("mcratio").alias("y"), F.when(F.col("first"), 1.0).otherwise(-1.0).alias("target")))
    return content.predict_content(rows, neuron)


@query(
    "f7_imm_loglik",
    f"""WITH {IMM_SQL}, w AS (SELECT seq_id, m, i, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs), (SELECT unnest([0, 1, 2]) AS m)),
    tb AS (SELECT model, hist || base AS w, p FROM (SELECT * FROM lv1 UNION ALL SELECT * FROM lv2 UNION ALL SELECT * FROM lv3 UNION ALL SELECT * FROM lv4 UNION ALL SELECT * FROM lv5)), lo AS (SELECT model, hist || base AS h, ln(p) AS l FROM lv6),
    bd AS (SELECT seq_id, m AS model, sum(l) AS l FROM w JOIN lo ON lo.model = (i + m) % 3 AND lo.h = w.h GROUP BY ALL),
    hd AS (SELECT seq_id, model, sum(ln(p)) AS l FROM (SELECT seq_id, substr(seq, 1, CAST(unnest(range(1, 6)) AS INT)) AS w FROM seqs) JOIN tb USING (w) GROUP BY ALL)
    SELECT seq_id, model, round(sum(l), 4) AS loglik FROM (SELECT * FROM bd UNION ALL SELECT * FROM hd) GROUP BY ALL""",
)
def f7(spark, d):
    return content.imm_loglik(T.seqs(spark, d), kmers.train_chi2_imm(periodic(spark, d))).withColumn("loglik", F.round("loglik", 4))


CLOUD_SQL = f"""{T.SEQS}, ps AS (SELECT seq_id, seq, CAST(('0x' || substr(md5(CAST(seq_id AS VARCHAR) || 's'), 1, 8)) AS BIGINT) % 3 AS part FROM seqs),
    dk AS (SELECT part, model, substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, count(*) AS n FROM (SELECT part, CAST(i % 3 AS INT) AS model, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT part, seq, unnest(range(0, length(seq) - 5)) AS i FROM ps)) GROUP BY ALL), {GRID5},
    dp AS (SELECT part, model, hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY part, model, hist) AS p FROM (SELECT part, model, hist, base FROM (SELECT DISTINCT part, model FROM dk), hh, {T.BASES}) LEFT JOIN dk USING (part, model, hist, base)),
    dm AS (SELECT model, hist, base, avg(p) AS mean, stddev_pop(p) AS sd, min(p) AS lo_rng, max(p) AS hi_rng FROM dp GROUP BY ALL)"""


@query(
    "e11_dynamic_model",
    f"""WITH {CLOUD_SQL} SELECT model, hist, base, round(mean, 9) AS mean, round(sd, 9) AS sd, round(lo_rng, 9) AS lo_rng, round(hi_rng, 9) AS hi_rng,
    round(least(greatest(mean - sd, 1e-5), 1 - 1e-5), 9) AS lo_var, round(least(greatest(mean + sd, 1e-5), 1 - 1e-5), 9) AS hi_var FROM dm""",
)
def e11(spark, d):
    rows = cloud(spark, d)
    return rows.select("model", "hist", "base", *(F.round(c, 9).alias(c) for c in rows.columns if c not in ("model", "hist", "base")))


def cloud(spark, d):
    seqs = T.seqs(spark, d).withColumn("part", sampling.partition_of(F.col("seq_id"), 3))
    both = kmers.count_kmers(seqs, F.col("part") * 3 + F.pmod(F.col("i"), F.lit(3)), "part", period=3)  # one pass over all parts
    return content.dynamic_model(both.withColumn("part", F.floor(F.col("model") / 3).cast("int")).withColumn("model", F.col("model") % 3))


@query(
    "f8_dynamic_loglik",
    f"""WITH {CLOUD_SQL}, fn AS (SELECT seq_id, model, substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, count(*) AS n FROM (SELECT seq_id, CAST(i % 3 AS INT) AS model, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs)) GROUP BY ALL),
    rw AS (SELECT seq_id, model, hist, base, coalesce(n, 0) AS n, lo_rng AS lo, hi_rng AS hi FROM (SELECT DISTINCT seq_id, model, hist FROM fn) JOIN dm USING (model, hist) LEFT JOIN fn USING (seq_id, model, hist, base)),
    sp AS (SELECT *, 1 - sum(lo) OVER (PARTITION BY seq_id, model, hist) - coalesce(sum(hi - lo) OVER (PARTITION BY seq_id, model, hist ORDER BY n DESC, base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM rw)
    SELECT seq_id, round(sum(n * ln(lo + greatest(0, least(hi - lo, rest)))) FILTER (n > 0), 4) AS loglik FROM sp GROUP BY ALL""",
)
def f8(spark, d):
    return content.dynamic_loglik(T.seqs(spark, d), cloud(spark, d)).withColumn("loglik", F.round("loglik", 4))


CLUSTER_SQL = f"""{T.LABELLED}, {MEDOID_SQL}, nm AS (SELECT seq_id, pos, site, len, arg_min(cluster, dist * 100 + cluster) AS cluster FROM (SELECT seq_id, pos, site, len, cluster, len(list_filter(range(1, 12), lambda i: substr(site, CAST(i AS INT), 1) <> substr(m, CAST(i AS INT), 1))) AS dist FROM mets, med) GROUP BY ALL)"""


@query(
    "f15_cluster_predict",
    f"""WITH {CLUSTER_SQL}, ct AS (SELECT cluster AS g, n.site FROM nm n JOIN lab USING (seq_id, pos) WHERE hyp = 'T' AND seq_id % 10 < 8), cf AS (SELECT 0 AS g, site FROM lab WHERE hyp = 'F' AND seq_id % 10 < 8), {wam_sql('wt', 'ct', 11, 5, 'ATG')}, {wam_sql('wf', 'cf', 11, 5, 'ATG')},
    k AS (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM nm WHERE (len - 98 - pos) // 3 >= 50),
    sc AS (SELECT seq_id, k.pos AS pos, round(sum(ln(t.p)) - sum(ln(f.p)), 6) AS llkr FROM k JOIN wt t ON t.g = k.cluster AND t.pos = k.k AND t.base = substr(site, k.k + 1, 1) AND t.prev = CASE WHEN k.k = 0 THEN '-' ELSE substr(site, k.k, 1) END
      JOIN wf f ON f.pos = k.k AND f.base = t.base AND f.prev = t.prev GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY llkr DESC, pos) AS r FROM sc) SELECT seq_id, CASE WHEN llkr >= 0 THEN pos ELSE -1 END AS tis, llkr AS score FROM b WHERE r = 1""",
)
def f15(spark, d):
    rows = sites.nearest_medoid(sites.labelled_sites(sites.met_sites(T.seqs(spark, d))), medoids(spark))
    true = sites.train_wam(rows.where("hyp = 'T' AND seq_id % 10 < 8"), ["cluster"])
    false = sites.train_wam(rows.where("hyp = 'F' AND seq_id % 10 < 8").withColumn("all", F.lit(0)), ["all"]).drop("all")
    every = sites.nearest_medoid(sites.met_sites(T.seqs(spark, d)), medoids(spark))
    return sites.predict_llkr(content.with_cluster_llkr(every, true, false))


#: Models of a cluster's true sites, matrices of both kinds, and every candidate's choice by mode.
MODE_SQL = {
    "hamming": "SELECT seq_id, pos, site, cluster FROM nm",
    "pwm": "SELECT seq_id, pos, site, arg_min(g, (-round(l, 9), g)) AS cluster FROM (SELECT n.seq_id, n.pos, n.site, m.g, sum(CASE WHEN m.p > 0 THEN ln(m.p) ELSE CAST('-infinity' AS DOUBLE) END) AS l FROM (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM nm) n JOIN wp m ON m.pos = n.k AND m.base = substr(n.site, n.k + 1, 1) GROUP BY ALL) GROUP BY ALL",
    "wam": "SELECT seq_id, pos, site, arg_min(g, (-round(l, 9), g)) AS cluster FROM (SELECT n.seq_id, n.pos, n.site, m.g, sum(CASE WHEN m.p > 0 THEN ln(m.p) ELSE CAST('-infinity' AS DOUBLE) END) AS l FROM (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM nm) n JOIN wt m ON m.pos = n.k AND m.base = substr(n.site, n.k + 1, 1) AND m.prev = CASE WHEN n.k = 0 THEN '-' ELSE substr(n.site, n.k, 1) END GROUP BY ALL) GROUP BY ALL",
}
PWM_SQL = f"""pc AS (SELECT g, pos, substr(site, pos + 1, 1) AS base, count(*) AS n FROM (SELECT g, site, CAST(unnest(range(0, 11)) AS INT) AS pos FROM ct) GROUP BY ALL),
    pf AS (SELECT g, pos, base, coalesce(CAST(coalesce(n, 0) AS DOUBLE) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY g, pos), 0), 0.25) AS p FROM (SELECT g, CAST(k AS INT) AS pos, base FROM (SELECT DISTINCT g FROM ct), range(0, 11) r(k), {T.BASES}) LEFT JOIN pc USING (g, pos, base)),
    wp AS (SELECT g, pos, base, CASE WHEN pos BETWEEN 5 AND 7 THEN p ELSE {T._SMOOTH} END AS p FROM pf WINDOW w AS (PARTITION BY g, pos))"""


def mode_sql(mode: str, static: bool) -> str:
    first = "SELECT seq_id, pos, site, first_value(cluster) OVER (PARTITION BY seq_id ORDER BY pos) AS cluster FROM chosen SEMI JOIN ca USING (seq_id, pos)"
    return f"""WITH {CLUSTER_SQL}, ct AS (SELECT cluster AS g, n.site FROM nm n JOIN lab USING (seq_id, pos) WHERE hyp = 'T' AND seq_id % 10 < 8), cf AS (SELECT 0 AS g, site FROM lab WHERE hyp = 'F' AND seq_id % 10 < 8), {wam_sql('wt', 'ct', 11, 5, 'ATG')}, {wam_sql('wf', 'cf', 11, 5, 'ATG')}, {PWM_SQL},
    ca AS (SELECT seq_id, pos FROM nm WHERE (len - 98 - pos) // 3 >= 50), chosen AS ({MODE_SQL[mode]}), fin AS ({first if static else 'SELECT * FROM chosen SEMI JOIN ca USING (seq_id, pos)'}), k AS (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM fin),
    sc AS (SELECT seq_id, k.pos AS pos, round(sum(ln(t.p)) - sum(ln(f.p)), 6) AS llkr FROM k JOIN wt t ON t.g = k.cluster AND t.pos = k.k AND t.base = substr(site, k.k + 1, 1) AND t.prev = CASE WHEN k.k = 0 THEN '-' ELSE substr(site, k.k, 1) END
      JOIN wf f ON f.pos = k.k AND f.base = t.base AND f.prev = t.prev GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY llkr DESC, pos) AS r FROM sc) SELECT seq_id, CASE WHEN llkr >= 0 THEN pos ELSE -1 END AS tis, llkr AS score FROM b WHERE r = 1"""


def cluster_mode(mode: str, static: bool):
    def run(spark, d):
        every = sites.nearest_medoid(sites.met_sites(T.seqs(spark, d)), medoids(spark))
        rows = sites.labelled_sites(every).where("seq_id % 10 < 8")
        of_true = rows.where("hyp = 'T'")
        true = sites.train_wam(of_true, ["cluster"])
        false = sites.train_wam(rows.where("hyp = 'F'").withColumn("all", F.lit(0)), ["all"]).drop("all")
        if mode != "hamming":
            packed = sites.packed_model(true, ["cluster"]) if mode == "wam" else sites.packed_pwm(sites.train_pwm(of_true, ["cluster"]), ["cluster"])
            every = content.best_cluster(every.drop("cluster", "dist"), packed)
        return sites.predict_llkr(content.with_cluster_llkr(every, true, false, static=static))

    return run


for _mode, _static in (("hamming", True), ("pwm", False), ("pwm", True), ("wam", False), ("wam", True)):
    query(f"f15_{'static' if _static else 'modulating'}_{_mode}", mode_sql(_mode, _static))(cluster_mode(_mode, _static))


@query(
    "f3_pwm_score",
    f"""WITH {T.LABELLED}, ct AS (SELECT hyp AS g, site FROM lab), {PWM_SQL}, k AS (SELECT seq_id, pos, site, CAST(unnest(range(0, 11)) AS INT) AS k FROM mets)
    SELECT seq_id, k.pos AS pos, g AS hyp, round(sum(ln(p)), 6) AS score FROM k JOIN wp ON wp.pos = k.k AND base = substr(site, k.k + 1, 1) GROUP BY ALL""",
)
def f3(spark, d):
    found = sites.met_sites(T.seqs(spark, d))
    return sites.pwm_score(found, sites.train_pwm(sites.labelled_sites(found), ["hyp"]), "hyp").select("seq_id", "pos", "hyp", F.round("score", 6).alias("score"))


@query("h2_sort_report", ORACLE["a13_tis_report"])
def h2(spark, d):
    return a13(spark, d).orderBy("tis", "seq_id")


@query("h6_distinct_coordinates", f"WITH {T.EXONS} SELECT DISTINCT contig_id, strand, start, stop, md5({T.slice_sql('start', 'stop')}) AS digest FROM exons JOIN contigs c USING (contig_id)")
def h6(spark, d):
    rows = structure.with_slices(T.exons(spark, d), T.contigs(spark, d)).select("contig_id", "strand", "start", "stop", F.md5(F.col("piece").cast("binary")).alias("digest"))
    return rows.dropDuplicates(["contig_id", "strand", "start", "stop", "digest"])


@query("h9_union", f"WITH {T.LABELLED} SELECT hyp, seq_id, pos FROM lab WHERE hyp = 'T' UNION ALL SELECT hyp, seq_id, pos FROM lab WHERE hyp = 'F'")
def h9(spark, d):
    rows = e1(spark, d).select("hyp", "seq_id", "pos")
    return rows.where("hyp = 'T'").unionByName(rows.where("hyp = 'F'"))


@query("d15_best_tallies", f"WITH {CLASSIFIED_SQL} SELECT best, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cl GROUP BY best")
def d15(spark, d):
    return kmers.best_tallies(f19(spark, d))


@query("f16_maximal_orf", f"""WITH {T.EXONS}, ge AS (SELECT gene, contig_id, strand, arg_min(start, exon_no) AS start, arg_max(stop, exon_no) AS stop FROM exons GROUP BY ALL),
    o AS (SELECT gene, strand, length(seq) AS n, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS g, CASE WHEN strand = '-' THEN length(seq) - start + 1 ELSE start END AS a, CASE WHEN strand = '-' THEN length(seq) - stop + 1 ELSE stop END AS b FROM ge JOIN contigs USING (contig_id)),
    v AS (SELECT *, (SELECT max(p) FROM (SELECT unnest(range((a - 1) % 3 + 1, a, 3)) AS p) WHERE substr(g, CAST(p AS INT), 3) IN ('TAA', 'TAG', 'TGA')) AS u, (SELECT min(p) FROM (SELECT unnest(range(b - 2, n - 1, 3)) AS p) WHERE substr(g, CAST(p AS INT), 3) IN ('TAA', 'TAG', 'TGA')) AS w
      FROM o WHERE a >= 1 AND b <= n AND b - a >= 2),
    z AS (SELECT *, coalesce(u + 3, a) AS x, coalesce(w + 2, b) AS y FROM v) SELECT gene, strand, CASE WHEN strand = '-' THEN n - x + 1 ELSE x END AS start, CASE WHEN strand = '-' THEN n - y + 1 ELSE y END AS stop FROM z WHERE x - 5 >= 1 AND y + 3 <= n""")  # fmt: skip
def f16(spark, d):
    genes = T.exons(spark, d).groupBy("gene", "contig_id", "strand").agg(F.min_by("start", "exon_no").alias("start"), F.max_by("stop", "exon_no").alias("stop"))
    return content.maximal_orf(genes, T.contigs(spark, d)).select("gene", "strand", "start", "stop")


def structure_sql(whole_codons: bool) -> str:
    frames = ORACLE["f16_maximal_orf"][len(f"WITH {T.EXONS}"):].replace(" SELECT gene, strand, CASE", ", mx AS (SELECT gene, strand, CASE") + ")"
    fits = "length(seq) > 200" + (" AND (length(seq) - 200) % 3 = 0" if whole_codons else "")
    return f"""WITH {T.WAM}{T.EXONS[len(T.CONTIGS):]}{frames},
    xw AS (SELECT e.gene, contig_id, e.strand, exon_no, CASE WHEN e.strand = '-' THEN -1 ELSE 1 END AS s, exon_no = min(exon_no) OVER w AS f, exon_no = max(exon_no) OVER w AS l, e.start AS es, e.stop AS ee, mx.start AS ms, mx.stop AS me FROM exons e JOIN mx USING (gene) WINDOW w AS (PARTITION BY e.gene)),
    wd AS (SELECT *, CASE WHEN f THEN ms ELSE es END AS start, CASE WHEN l THEN me ELSE ee END AS stop FROM xw),
    fl AS (SELECT gene, contig_id, strand, exon_no, CASE WHEN f THEN start - 101 * s ELSE start END AS start, CASE WHEN l THEN stop + 99 * s ELSE stop END AS stop FROM wd),
    pc AS (SELECT gene, exon_no, {T.slice_sql('start', 'stop')} AS piece FROM fl JOIN contigs c USING (contig_id)), sp AS (SELECT gene, string_agg(piece, '' ORDER BY exon_no) AS seq FROM pc GROUP BY gene HAVING count(piece) = count(*)),
    mt AS (SELECT gene, pos, substr(seq, pos - 5, 11) AS site, length(seq) AS len FROM (SELECT gene, seq, CAST(unnest(range(102, length(seq) - 100, 3)) AS INT) AS pos FROM sp WHERE {fits}) WHERE substr(seq, pos, 3) = 'ATG' AND pos + 5 <= length(seq) AND pos + 2 <= length(seq) - 99),
    sg AS (SELECT gene, m.pos AS pos, any_value(len) AS len, round(sum(ln(p)) FILTER (hyp = 'T') - sum(ln(p)) FILTER (hyp = 'F'), 6) AS llkr FROM (SELECT *, CAST(unnest(range(0, 11)) AS INT) AS k FROM mt) m JOIN wam w ON w.pos = m.k AND w.base = substr(m.site, m.k + 1, 1) AND w.prev = CASE WHEN m.k = 0 THEN '-' ELSE substr(m.site, m.k, 1) END GROUP BY gene, m.pos),
    bs AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY llkr DESC, pos) AS r FROM sg WHERE (len - 98 - pos) // 3 >= 50),
    gt AS (SELECT *, coalesce(sum(abs(stop - start) + 1) OVER (PARTITION BY gene ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM wd),
    gp AS (SELECT gene, start + s * (pos - 101 - t - 1) AS position FROM gt JOIN bs USING (gene) WHERE r = 1 AND llkr >= 0 AND pos - 101 > t AND pos - 101 <= t + abs(stop - start) + 1)
    SELECT mx.gene, CAST(mx.start AS BIGINT) AS orf_amino_bound, CAST(coalesce(position, mx.start) AS BIGINT) AS start_codon, mx.stop - 2 * CASE WHEN mx.strand = '-' THEN -1 ELSE 1 END AS stop_codon, llkr AS score, position IS NOT NULL AS met_seen FROM mx LEFT JOIN bs ON bs.gene = mx.gene AND r = 1 LEFT JOIN gp ON gp.gene = mx.gene"""


@query(
    "e10_induce_pseudocounts",
    f"WITH {KMERS_SQL}, {GRID5}, ig AS (SELECT model, hist || base AS w, coalesce(n, 1) AS n FROM (SELECT model, hist, base FROM (SELECT DISTINCT model FROM km), hh, {T.BASES}) LEFT JOIN (SELECT * FROM km WHERE k = 6) USING (model, hist, base)) "
    "SELECT model, k, substr(w, 1, k - 1) AS hist, substr(w, k, 1) AS base, CAST(sum(n) AS BIGINT) AS n FROM (SELECT model, w, n, CAST(unnest(range(1, 7)) AS INT) AS k FROM ig) GROUP BY ALL",
)
def e10(spark, d):
    return kmers.induce_pseudocounts(periodic(spark, d))


BINNED_SQL = f"""{T.SEQS}, bw AS (SELECT length(s) - length(translate(s, 'GC', '')) AS gc FROM (SELECT substr(seq, CAST(p AS INT), 100) AS s FROM (SELECT seq, unnest(range(1, length(seq) - 98)) AS p FROM contigs WHERE length(seq) >= 100))
      UNION ALL SELECT 100 * (length(seq) - length(translate(seq, 'GC', ''))) // length(seq) FROM contigs WHERE length(seq) BETWEEN 1 AND 99), bh AS (SELECT CAST(gc AS INT) AS gc, count(*) AS n FROM bw GROUP BY ALL),
    bc AS (SELECT gc, sum(n) OVER (ORDER BY gc) AS t, sum(n) OVER () AS a FROM bh), bb AS MATERIALIZED (SELECT CAST(q AS INT) AS q, min(gc) AS bound FROM bc, range(1, 5) r(q) WHERE t * 4 >= q * a GROUP BY ALL),
    bs AS MATERIALIZED (SELECT seq_id, seq, coalesce((SELECT min(q) FROM bb WHERE bound >= gc), (SELECT max(q) FROM bb)) AS q FROM (SELECT *, 100 * (length(seq) - length(translate(seq, 'GC', ''))) // length(seq) AS gc FROM seqs)),
    bk AS MATERIALIZED (SELECT seq_id, q, CAST(i % 3 AS INT) AS model, substr(seq, CAST(i AS INT) + 1, 6) AS h FROM (SELECT seq_id, q, seq, unnest(range(0, length(seq) - 5)) AS i FROM bs)), bn AS (SELECT q, model, substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, count(*) AS n FROM bk GROUP BY ALL), {GRID5},
    bf AS (SELECT q, model, hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY q, model, hist) AS p FROM (SELECT q, model, hist, base FROM (SELECT DISTINCT q, model FROM bn), hh, {T.BASES}) LEFT JOIN bn USING (q, model, hist, base))"""


def binned(spark, d):
    return kmers.with_gc_bin(T.seqs(spark, d), d17(spark, d))


@query("e12_gc_fixed_order", f"WITH {BINNED_SQL} SELECT q, model, hist, base, round(p, 9) AS p FROM bf")
def e12(spark, d):
    return kmers.train_gc_fixed_order(binned(spark, d)).withColumn("p", F.round("p", 9))


@query("f22_gc_loglik", f"WITH {BINNED_SQL} SELECT seq_id, q, round(sum(ln(p)), 4) AS loglik FROM bk JOIN bf USING (q, model) WHERE bf.hist = substr(h, 1, 5) AND bf.base = substr(h, 6, 1) GROUP BY ALL")
def f22(spark, d):
    rows = binned(spark, d)
    return kmers.gc_loglik(rows, kmers.train_gc_fixed_order(rows)).withColumn("loglik", F.round("loglik", 4))


@query(
    "f20_pmmm",
    ORACLE["f8_dynamic_loglik"].replace("SELECT seq_id, round(sum(n * ln(lo + greatest(0, least(hi - lo, rest)))) FILTER (n > 0), 4) AS loglik FROM sp GROUP BY ALL", "")
    + f""", dy AS (SELECT seq_id, sum(n * ln(lo + greatest(0, least(hi - lo, rest)))) FILTER (n > 0) AS c FROM sp GROUP BY ALL),
    nx AS (SELECT substr(s, CAST(i AS INT) + 1, 6) AS h, count(*) AS n FROM (SELECT s, unnest(range(0, length(s) - 5)) AS i FROM (SELECT reverse(translate(seq, 'ACGT', 'TGCA')) AS s FROM seqs)) GROUP BY ALL),
    ny AS (SELECT hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY hist) AS p FROM (SELECT hist, base FROM hh, {T.BASES}) LEFT JOIN (SELECT substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, n FROM nx) USING (hist, base)),
    nz AS (SELECT seq_id, sum(n * ln(p)) AS f FROM fn JOIN ny USING (hist, base) GROUP BY ALL) SELECT seq_id, round(c - f, 4) AS ratio, c >= f AS coding FROM dy JOIN nz USING (seq_id)""",
)
def f20(spark, d):
    """Coding by the dynamic model's best likelihood, noncoding by a fixed-order chain."""
    noncoding = kmers.train_fixed_order(kmers.count_kmers(T.seqs(spark, d).withColumn("seq", S.revcomp(F.col("seq"))), F.lit(3), period=1))
    rows = content.dynamic_loglik(T.seqs(spark, d), cloud(spark, d)).withColumnRenamed("loglik", "c")
    rows = rows.join(kmers.fo_loglik(T.seqs(spark, d), noncoding, periodic=False).select("seq_id", F.col("loglik").alias("f")), "seq_id")
    return rows.select("seq_id", F.round(F.col("c") - F.col("f"), 4).alias("ratio"), (F.col("c") >= F.col("f")).alias("coding"))


@query("f17_predict_structures", structure_sql(True))
def f17(spark, d):
    return content.predict_structures(T.genes(spark, d), T.contigs(spark, d), sites.train_wam(training(spark, d), ["hyp"]))


@query("f18_predict_isoforms", structure_sql(False))
def f18(spark, d):
    return content.predict_structures(T.genes(spark, d), T.contigs(spark, d), sites.train_wam(training(spark, d), ["hyp"]), whole_codons=False)


@query(
    "d17_gc_quantiles",
    ORACLE["d16_gc_histogram"].replace(" SELECT CAST(gc AS INT) AS gc, count(*) AS n FROM w GROUP BY ALL", ", h AS (SELECT CAST(gc AS INT) AS gc, count(*) AS n FROM w GROUP BY ALL)")
    + ", c AS (SELECT gc, sum(n) OVER (ORDER BY gc) AS t, sum(n) OVER () AS a FROM h) SELECT CAST(q AS INT) AS q, min(gc) AS bound FROM c, range(1, 5) r(q) WHERE t * 4 >= q * a GROUP BY ALL",
)
def d17(spark, d):
    return kmers.gc_quantiles(d16(spark, d))


# GC bins by position

_QB = f"""{T.SEQS}, bw AS (SELECT length(s) - length(translate(s, 'GC', '')) AS gc FROM (SELECT substr(seq, CAST(p AS INT), 100) AS s FROM (SELECT seq, unnest(range(1, length(seq) - 98)) AS p FROM contigs WHERE length(seq) >= 100))
      UNION ALL SELECT 100 * (length(seq) - length(translate(seq, 'GC', ''))) // length(seq) FROM contigs WHERE length(seq) BETWEEN 1 AND 99), bh AS (SELECT CAST(gc AS INT) AS gc, count(*) AS n FROM bw GROUP BY ALL),
    bc AS (SELECT gc, sum(n) OVER (ORDER BY gc) AS t, sum(n) OVER () AS a FROM bh), bb AS MATERIALIZED (SELECT CAST(q AS INT) AS q, min(gc) AS bound FROM bc, range(1, 5) r(q) WHERE t * 4 >= q * a GROUP BY ALL),
    qp AS (SELECT seq_id, i, substr(seq, CAST(i AS INT) + 1, 6) AS h, i BETWEEN 47 AND length(seq) - 53 AS inside, substr(seq, CAST(least(greatest(i - 47, 0), length(seq) - 100) AS INT) + 1, 100) AS w
        FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 5)) AS i FROM seqs)),
    qg AS (SELECT *, length(w) - length(translate(w, 'GC', '')) AS gc FROM qp), qm AS (SELECT gc, coalesce((SELECT min(q) FROM bb WHERE bound >= gc), (SELECT max(q) FROM bb)) AS q FROM (SELECT DISTINCT gc FROM qg)),
    qh AS MATERIALIZED (SELECT seq_id, CAST(i % 3 AS INT) AS model, h, inside, q FROM qg JOIN qm USING (gc)), q6 AS (SELECT q, model, h, count(*) AS n FROM qh WHERE inside GROUP BY ALL)"""


def gc_counts(spark, d):
    return kmers.count_gc_kmers(T.seqs(spark, d), d17(spark, d), F.pmod(F.col("i"), F.lit(3)), period=3)


@query("d5_gc_window_counts", f"WITH {_QB} SELECT q, model, k, substr(h, 1, k - 1) AS hist, substr(h, k, 1) AS base, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, CAST(unnest(range(1, 7)) AS INT) AS k FROM q6) GROUP BY ALL")
def d5(spark, d):
    """Hexamers, and the shorter words at their heads, by the GC bin of the window in whose middle each stands."""
    return gc_counts(spark, d)


@query(
    "f22_gc_window_loglik",
    f"""WITH {_QB}, {GRID5}, qc AS (SELECT q, model, hist, base, (coalesce(n, 0) + 5) / sum(coalesce(n, 0) + 5) OVER (PARTITION BY q, model, hist) AS p FROM (SELECT q, model, hist, base FROM (SELECT DISTINCT q, model FROM q6), hh, {T.BASES})
      LEFT JOIN (SELECT q, model, substr(h, 1, 5) AS hist, substr(h, 6, 1) AS base, n FROM q6) USING (q, model, hist, base))
    SELECT seq_id, round(sum(ln(p)), 4) AS loglik FROM qh JOIN qc USING (q, model) WHERE qc.hist = substr(h, 1, 5) AND qc.base = substr(h, 6, 1) GROUP BY ALL""",
)
def f22_windows(spark, d):
    """Every hexamer under the chain of its own window's GC bin; chains are trained on the counts of d5."""
    bounds = d17(spark, d).persist()  # a handful of rows, which two steps read
    chains = kmers.train_by_bin(kmers.train_fixed_order, kmers.count_gc_kmers(T.seqs(spark, d), bounds, F.pmod(F.col("i"), F.lit(3)), period=3))
    rows = kmers.gc_window_loglik(T.seqs(spark, d), bounds, chains)
    return rows.withColumn("loglik", F.round("loglik", 4))


# Pairs of vectors

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_MSD = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) / len(a.x)"


def embeddings(spark, d):
    return T.read(spark, d, "embeddings").select("vec_id", "label", "embedding")


@query(
    "v1_nearest_by_metric",
    f"""WITH {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.x AS x, b.x AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
    m AS (SELECT a, b, unnest(['euclid', 'cityblock', 'correlation', 'absolute correlation', 'uncentred correlation', 'absolute uncentred correlation']) AS metric,
      unnest([{_PAIR.format('(x[i] - y[i]) * (x[i] - y[i])')} / len(x), {_PAIR.format('abs(x[i] - y[i])')} / len(x), {_correlation_sql('x', 'y')}, 1 - abs(1 - ({_correlation_sql('x', 'y')})),
        1 - {_PAIR.format('x[i] * y[i]')} / sqrt({_PAIR.format('x[i] * x[i]')} * {_PAIR.format('y[i] * y[i]')}), 1 - abs({_PAIR.format('x[i] * y[i]')} / sqrt({_PAIR.format('x[i] * x[i]')} * {_PAIR.format('y[i] * y[i]')}))]) AS dist FROM p)
    SELECT a, metric, rank, b, round(dist, 6) AS dist FROM (SELECT *, CAST(row_number() OVER (PARTITION BY metric, a ORDER BY dist, b) AS INT) AS rank FROM m) WHERE rank <= 5""",
)
def v1_nearest(spark, d):
    """The five nearest of all vectors for every twentieth, under six metrics; a search whose queries are fixed rows."""
    rows = embeddings(spark, d)
    found = None
    for metric in ("euclid", "cityblock", "correlation", "absolute correlation", "uncentred correlation", "absolute uncentred correlation"):
        own = vectors.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, metric).withColumn("metric", F.lit(metric))
        found = own if found is None else found.union(own)
    return found.select("a", "metric", "rank", "b", F.round("dist", 6).alias("dist"))


@query(
    "v4_density_weights",
    f"""WITH {_E}, p AS (SELECT a.vec_id AS a, {_MSD} AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id)
    SELECT e.vec_id, round(1 / (1 + coalesce(sum(pow(1 - d / {{c}}, 2)) FILTER (d < {{c}}), 0)), 6) AS weight FROM e LEFT JOIN p ON p.a = e.vec_id GROUP BY ALL""".format(c=0.025),
)
def v4(spark, d):
    return vectors.density_weights(embeddings(spark, d), "vec_id", "embedding", 0.025, 2).withColumn("weight", F.round("weight", 6))


@query(
    "v3_linkage",
    f"""WITH {_E}, p AS (SELECT a.label AS a, b.label AS b, {_MSD} AS d FROM e a JOIN e b ON a.label < b.label), k AS (SELECT label, k, avg(v) AS m, median(v) AS md FROM (SELECT label, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS v FROM e) GROUP BY ALL),
    c AS (SELECT a.label AS a, b.label AS b, avg((a.m - b.m) * (a.m - b.m)) AS means, avg((a.md - b.md) * (a.md - b.md)) AS medians FROM k a JOIN k b ON a.k = b.k AND a.label < b.label GROUP BY ALL)
    SELECT a, b, round(min(d), 6) AS smallest, round(max(d), 6) AS largest, round(avg(d), 6) AS average, round(means, 6) AS means, round(medians, 6) AS medians FROM p JOIN c USING (a, b) GROUP BY a, b, means, medians""",
)
def v3_linkage(spark, d):
    """Distances of clusters: smallest, largest and average pair, between means, between medians."""
    out = vectors.linkage(embeddings(spark, d), "label", "embedding")
    return out.select("a", "b", *(F.round(c, 6).alias(c) for c in ("smallest", "largest", "average", "means", "medians")))


# Rejects and documents


@query(
    "b9_training_rejects",
    f"""WITH {T.CONTIGS} SELECT contig_id, CASE WHEN length(seq) < 97 THEN 'short' WHEN length(seq) < 107 THEN 'first codon' WHEN length(seq) - 101 < 102 THEN 'order'
      WHEN (length(seq) - 99 - 102 + 1) % 3 <> 0 THEN 'frame' END AS reason FROM contigs""",
)
def b9_rejects(spark, d):
    return T.contigs(spark, d).select("contig_id", S.training_reject(F.length("seq")).alias("reason"))


@query(
    "c2_splice_rejects",
    ORACLE["c2_splice_with_flanks"].replace(SPLICE, "SELECT gene, md5(seq) AS digest, CASE WHEN seq IS NULL THEN 'contig' WHEN substr(seq, 102, 3) <> 'ATG' THEN 'start' END AS reason FROM (SELECT gene, CASE WHEN count(piece) = count(*) THEN string_agg(piece, '' ORDER BY exon_no) END AS seq FROM p GROUP BY gene)"),
)
def c2_rejects(spark, d):
    rows = structure.splice_report(T.exons(spark, d), T.contigs(spark, d), require_start=True)
    return rows.select("gene", F.md5(F.col("seq").cast("binary")).alias("digest"), "reason")


@query(
    "a13_tis_rejects",
    f"""WITH {T.SCORED}, b AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY llkr DESC, pos) AS r FROM cand)
    SELECT c.contig_id AS seq_id, CASE WHEN length(c.seq) < 350 THEN 'short' WHEN llkr IS NULL THEN 'no site' ELSE 'score' END AS reason
    FROM contigs c LEFT JOIN b ON b.seq_id = c.contig_id AND r = 1 WHERE llkr IS NULL OR llkr < 0""",
)
def a13_rejects(spark, d):
    all_of = T.contigs(spark, d).select(F.col("contig_id").alias("seq_id"), F.length("seq").alias("n"))
    report = sites.tis_report(all_of, sites.predict_llkr(scored(spark, d)), F.when(F.col("n") < 350, "short"))
    return report.where("reason IS NOT NULL").select("seq_id", "reason")


@query("h2_first_of_report", f"SELECT seq_id, tis, CAST(row_number() OVER (ORDER BY tis DESC, seq_id) AS INT) AS place FROM ({ORACLE['a13_tis_report']}) ORDER BY tis DESC, seq_id LIMIT 100")
def h2_first(spark, d):
    """The hundred last starts, in order."""
    top = a13(spark, d).orderBy(F.desc("tis"), "seq_id").limit(100)
    return top.select("seq_id", "tis", F.row_number().over(Window.orderBy(F.desc("tis"), "seq_id")).alias("place"))  # of a hundred rows


def documents_of(spark, d, annotated: bool) -> str:
    """Path of XML documents: every gene as a reading frame, with two annotations or none; up to four genes of a contig are one parent."""
    rows, n = T.genes(spark, d), T.read(spark, d, "documents").count()
    if annotated:  # two steps read them
        genes_path = shared.new_path(spark, "genes")
        rows.write.option("compression", "zstd").parquet(genes_path)
        rows = spark.read.parquet(genes_path)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.coalesce(F.abs(p["stop"] - p["start"]) + 1, F.lit(0)))
    genes = rows.withColumn("n_nt", length).select(
        "gene", F.col("contig_id").alias("gdna_id"), "strand", F.floor(F.col("gene") / (4 * n)).alias("pgl"), F.lit(1).alias("ags"), F.col("gene").alias("pps"), (F.col("gene") % 3).alias("frame"),
        F.transform("parts", lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"))).alias("exons"), "n_nt", F.floor(F.col("n_nt") / 3).alias("n_aa"), F.concat(F.lit("M"), F.col("gene").cast("string"), F.lit("<&*")).alias("peptide"),
    )
    if annotated:
        found = content.predict_structures(rows, T.contigs(spark, d), sites.train_wam(training(spark, d), ["hyp"]))
        twice = found.withColumn("method", F.explode(F.when(F.col("met_seen"), F.array(F.lit("log-likelihood ratios"), F.lit("starts only"))).otherwise(F.array(F.lit("log-likelihood ratios")))))
        genes = structure.annotate(genes, twice)
    path = shared.new_path(spark, "frames")
    xml.write_gth_orfs(genes, path, compression="gzip")
    return path


@query(
    "a14_annotated_documents",
    f"""WITH {T.EXONS}, pr AS ({ORACLE['f17_predict_structures']}), gn AS (SELECT gene, contig_id, strand, md5(string_agg(start || '-' || stop, ',' ORDER BY exon_no)) AS exons FROM exons GROUP BY ALL)
    SELECT gn.gene, CAST(contig_id AS VARCHAR) AS gdna_id, strand, CAST(gn.gene % 3 AS INT) AS frame, 'M' || gn.gene || '<&*' AS peptide, exons, method, orf_amino_bound, start_codon, stop_codon, score, met_seen
    FROM gn LEFT JOIN (SELECT 'log-likelihood ratios' AS method, * FROM pr UNION ALL SELECT 'starts only', * FROM pr WHERE met_seen) p USING (gene)""",
)
def a14(spark, d):
    """Annotations written into documents, and read back from them."""
    rows = xml.read_gth_orfs(spark, documents_of(spark, d, True))
    pairs = F.array_join(F.transform("exons", lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["stop"].cast("string"))), ",")
    rows = rows.select(F.col("pps").alias("gene"), "gdna_id", "strand", "frame", "peptide", F.md5(pairs.cast("binary")).alias("exons"), F.explode_outer("annots").alias("a"))
    return rows.select("gene", "gdna_id", "strand", "frame", "peptide", "exons", "a.method", "a.orf_amino_bound", "a.start_codon", "a.stop_codon", F.col("a.best_tis_score").alias("score"), "a.met_seen")


@query(
    "a3_first_frames",
    f"WITH {T.EXONS} SELECT CAST(contig_id AS VARCHAR) AS gdna_id, strand, gene // (4 * (SELECT count(*) FROM documents)) AS pgl, min(gene) AS gene FROM exons GROUP BY ALL",
)
def a3(spark, d):
    """The first reading frame of each parent element."""
    return xml.read_gth_orfs(spark, documents_of(spark, d, False), first_only=True).select("gdna_id", "strand", "pgl", F.col("pps").alias("gene"))
