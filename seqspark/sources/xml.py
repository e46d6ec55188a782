"""Gene-structure documents through Spark's XML reader, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXON = "array<struct<_start: bigint, _stop: bigint>>"
#: Attributes of an annotation, in the names of the format, and the columns that hold them.
ANNOTATION = {
    "method": ("method", "string"), "orf_amino_bound": ("orf_amino_bound", "bigint"), "start_codon": ("start_codon", "bigint"), "stop_codon": ("stop_codon", "bigint"),
    "best_TIS_score": ("best_tis_score", "double"), "Met_seen_p": ("met_seen", "int"),
}
ANNOTS = "array<struct<" + ", ".join(f"_{k} {t}" for k, (_, t) in ANNOTATION.items()) + ">>"
ORF_HEAD = (
    "gDNA struct<_id string, _strand string>, serials struct<_PGL_serial bigint, _AGS_serial bigint, _PPS_serial bigint>, "
    "orf_info struct<exon_boundaries struct<exon " + EXON + ">, frame int, number_coding_nucleotides bigint, number_encoded_amino_acids bigint>"
)
MODEL = "_CURATED int, FEAT_NAME string, EXON array<struct<CDS: struct<COORDSET: struct<END5: bigint, END3: bigint>>>>, PROTEIN_SEQUENCE string"
MEDOIDS = "_stringsize int, _k int, _error double, medoid array<struct<_id: int, _VALUE: string>>"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _locus(annot: str) -> str:
    return f"_id string, isoform array<struct<_serial bigint, _score double, exon {EXON}, `{annot}` {ANNOTS}>>, none string"


def _orf(annot: str) -> str:
    """A reading frame; its id, serials and exons stand in an id_line, or without one."""
    return f"id_line struct<{ORF_HEAD}>, {ORF_HEAD}, predicted_protein_sequence string, `{annot}` {ANNOTS}"


def _exons(exons: Column) -> Column:
    return F.transform(exons, lambda e: F.struct(e["_start"].alias("start"), e["_stop"].alias("stop")))


def _to_exons(exons: Column) -> Column:
    return F.transform(exons, lambda e: F.struct(e["start"].cast("bigint").alias("_start"), e["stop"].cast("bigint").alias("_stop")))


def _annots(annots: Column) -> Column:
    """Annotations as structure.annotate() makes them; none is an empty array."""
    fields = lambda a: [a[f"_{k}"].cast("boolean" if name == "met_seen" else t).alias(name) for k, (name, t) in ANNOTATION.items()]
    found = F.transform(annots, lambda a: F.struct(*fields(a)))
    return F.coalesce(found, F.array().cast("array<struct<" + ", ".join(f"{name} {'boolean' if name == 'met_seen' else t}" for name, t in ANNOTATION.values()) + ">>"))


def _to_annots(annots: Column) -> Column:
    return F.transform(annots, lambda a: F.struct(*(a[name].cast(t).alias(f"_{k}") for k, (name, t) in ANNOTATION.items())))


def read_pasif_isoforms(spark: SparkSession, path: str, annot: str = "annot") -> DataFrame:
    """(locus_id, serial, score, exons, annots), a row for each isoform; annot is the element of an annotation."""
    rows = _read(spark, path, "locus", _locus(annot)).select(F.col("_id").alias("locus_id"), F.explode("isoform").alias("i"))
    return rows.select("locus_id", F.col("i._serial").alias("serial"), F.col("i._score").alias("score"), _exons(F.col("i.exon")).alias("exons"), _annots(F.col(f"i.`{annot}`")).alias("annots"))


def read_pasif(spark: SparkSession, path: str) -> DataFrame:
    """(locus_id, serial, score, exon_no, start, stop); loci without isoforms give no rows."""
    rows = read_pasif_isoforms(spark, path).select("locus_id", "serial", "score", F.posexplode("exons").alias("n", "e"))
    return rows.select("locus_id", "serial", "score", (F.col("n") + 1).alias("exon_no"), "e.start", "e.stop")


def write_pasif(isoforms: DataFrame, path: str, annot: str = "annot") -> None:
    """isoforms(locus_id, serial, score, exons, annots) as documents that read_pasif_isoforms() reads back; annots may be absent.

    Each partition is a document of its own with a root. Isoforms of a locus are nested in it by serial; a locus holds few."""
    isoforms = isoforms if "annots" in isoforms.columns else isoforms.withColumn("annots", _annots(F.lit(None).cast(ANNOTS)))
    item = F.struct(F.col("serial").cast("bigint").alias("_serial"), F.col("score").cast("double").alias("_score"), _to_exons(F.col("exons")).alias("exon"), _to_annots(F.col("annots")).alias(annot))
    rows = isoforms.groupBy(F.col("locus_id").alias("_id")).agg(F.array_sort(F.collect_list(item)).alias("isoform"))
    rows.write.format("xml").option("rootTag", "PASIF_output").option("rowTag", "locus").save(path)


def read_gth_orfs(spark: SparkSession, path: str, first_only: bool = False, annot: str = "annot") -> DataFrame:
    """Reading frames: (gdna_id, strand, pgl, ags, pps, frame, exons, n_nt, n_aa, peptide, annots).

    first_only takes the first one of each parent element, as training does; parents without any give no rows."""
    if first_only:
        parents = _read(spark, path, "probable_ORFs", f"orf_entry array<struct<{_orf(annot)}>>, none string")
        rows = parents.select(F.get("orf_entry", F.lit(0)).alias("o")).where("o IS NOT NULL").select("o.*")
    else:
        rows = _read(spark, path, "orf_entry", _orf(annot))
    head = lambda name: F.coalesce(F.col(f"id_line.{name}"), F.col(name))
    return rows.select(
        head("gDNA._id").alias("gdna_id"), head("gDNA._strand").alias("strand"), head("serials._PGL_serial").alias("pgl"), head("serials._AGS_serial").alias("ags"), head("serials._PPS_serial").alias("pps"),
        head("orf_info.frame").alias("frame"), _exons(head("orf_info.exon_boundaries.exon")).alias("exons"), head("orf_info.number_coding_nucleotides").alias("n_nt"),
        head("orf_info.number_encoded_amino_acids").alias("n_aa"), F.col("predicted_protein_sequence").alias("peptide"), _annots(F.col(f"`{annot}`")).alias("annots"),
    )


def write_gth_orfs(orfs: DataFrame, path: str, annot: str = "annot", compression: str = "none") -> None:
    """Reading frames, annotated or not, as documents that read_gth_orfs() reads back.

    orfs has that reader's columns; annots may be absent. Each partition is a document of its own with a root, compressed on request. The
    frames of one gene structure (gdna_id, strand, pgl, ags) are one parent element, ordered by pps; a structure
    holds few. Frames without a serial are parents of their own."""
    orfs = orfs if "annots" in orfs.columns else orfs.withColumn("annots", _annots(F.lit(None).cast(ANNOTS)))
    info = F.struct(F.struct(_to_exons(F.col("exons")).alias("exon")).alias("exon_boundaries"), F.col("frame").cast("int").alias("frame"), F.col("n_nt").cast("bigint").alias("number_coding_nucleotides"), F.col("n_aa").cast("bigint").alias("number_encoded_amino_acids"))
    line = F.struct(
        F.struct(F.col("gdna_id").cast("string").alias("_id"), F.col("strand").alias("_strand")).alias("gDNA"),
        F.struct(F.col("pgl").cast("bigint").alias("_PGL_serial"), F.col("ags").cast("bigint").alias("_AGS_serial"), F.col("pps").cast("bigint").alias("_PPS_serial")).alias("serials"),
        info.alias("orf_info"),
    )
    entry = F.struct(line.alias("id_line"), F.col("peptide").alias("predicted_protein_sequence"), _to_annots(F.col("annots")).alias(annot))
    lone = F.when(F.col("pgl").isNull() | F.col("ags").isNull(), F.monotonically_increasing_id())
    rows = orfs.withColumn("__lone", lone).groupBy("gdna_id", "strand", "pgl", "ags", "__lone").agg(F.array_sort(F.collect_list(F.struct(F.col("pps").alias("at"), entry.alias("e")))).alias("x"))
    rows.select(F.transform("x", lambda x: x["e"]).alias("orf_entry")).write.format("xml").option("rootTag", "reading_frames").option("rowTag", "probable_ORFs").option("compression", compression).save(path)


def read_tigr_models(spark: SparkSession, path: str, min_peptide: int = 100) -> DataFrame:
    """Curated models with at least min_peptide residues as (model_id, exon_no, start, stop)."""
    rows = _read(spark, path, "MODEL", MODEL).where("_CURATED = 1")
    rows = rows.where(F.length(F.regexp_replace("PROTEIN_SEQUENCE", r"\*$", "")) >= min_peptide)
    parts = F.filter(F.transform("EXON", lambda e: e["CDS"]["COORDSET"]), lambda c: c.isNotNull())
    rows = rows.select(F.col("FEAT_NAME").alias("model_id"), F.posexplode(parts).alias("n", "c"))
    return rows.select("model_id", (F.col("n") + 1).alias("exon_no"), F.col("c.END5").alias("start"), F.col("c.END3").alias("stop"))


def read_medoids(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, site, k, error); raises where the ids are not 1..k or lengths differ from stringsize."""
    head = _read(spark, path, "kmedoids", MEDOIDS)
    rows = head.select("_stringsize", F.col("_k").alias("k"), F.col("_error").alias("error"), F.explode("medoid").alias("m"))
    rows = rows.select(F.col("m._id").alias("cluster"), F.trim(F.col("m._VALUE")).alias("site"), "k", "error", "_stringsize")
    wrong = rows.agg(F.count_distinct("cluster") != F.max("k"), F.min("cluster") != 1, F.max("cluster") != F.max("k"), F.bool_or(F.length("site") != F.col("_stringsize"))).first()
    if any(wrong):
        raise ValueError("medoids must be numbered 1..k and have the stated length")
    return rows.drop("_stringsize")


def write_medoids(medoids: DataFrame, path: str) -> None:
    """medoids(cluster, site, k, error) as one document with the attributes that read_medoids() expects."""
    item = F.struct(F.col("cluster").alias("_id"), F.col("site").alias("_VALUE"))
    rows = medoids.groupBy("k", "error").agg(F.array_sort(F.collect_list(item)).alias("medoid"), F.max(F.length("site")).alias("_stringsize"))
    rows = rows.select("_stringsize", F.col("k").alias("_k"), F.col("error").alias("_error"), "medoid")
    rows.coalesce(1).write.format("xml").option("rootTag", "clusters").option("rowTag", "kmedoids").save(path)
