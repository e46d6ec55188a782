"""Spliced alignments, as plain text or XML: predicted gene structures, and gene locations with the structures they rest on.

Both readers give two tables. Structures are (ref, exons, scores), one row an alignment: the reference's id, the exons'
array<struct<start, stop>> in the order of the file, and their scores. Locations are (pgl, ref, exons, orf, peptide), one
row for each structure of a location: pgl names the location by file and number, orf and peptide are the header
and protein of its first reading frame (null where it has none). operators.content.supported_structures() joins them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EXON = "array<struct<_start: bigint, _stop: bigint>>"
_FRAME = "gDNA: struct<_id: string, _strand: string>, exon_boundaries: struct<exon: " + _EXON + ">"
STRUCTURE = (
    "`exon-intron_info` struct<exon: array<struct<gDNA_exon_boundary: struct<_g_start: bigint, _g_stop: bigint>, reference_exon_boundary: struct<_r_score: double>>>>, MATCH_line struct<_ref_id: string>"
)
LOCATION = (
    "PGL_line struct<_PGL_serial: bigint>, AGS_information array<struct<supporting_evidence: struct<PGS_line: array<struct<gDNA_exon_coordinates: struct<exon: " + _EXON + ">, referenceDNA: struct<_id: string>, referenceProtein: struct<_id: string>>>>, "
    "three_phase_translation: struct<probable_ORFs: struct<orf_entry: array<struct<id_line: struct<" + _FRAME + ", orf_info: struct<exon_boundaries: struct<exon: " + _EXON + ">>>, " + _FRAME + ", predicted_protein_sequence: string>>>>>>"
)


def _pairs(text: Column, pattern: str) -> Column:
    """array<struct<start, stop>> of the pattern's two numbers, wherever it occurs in text."""
    numbers = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    return F.transform(F.arrays_zip(numbers(1).alias("a"), numbers(2).alias("b")), lambda x: F.struct(x["a"].cast("long").alias("start"), x["b"].cast("long").alias("stop")))


def read_text_structures(spark: SparkSession, path: str) -> DataFrame:
    """(ref, exons, scores) of plain text: a record runs from one 'Predicted gene structure' to the next, so that
    files are split between tasks; introns and a poly-A line are passed over, the reference stands in the MATCH line."""
    rows = spark.read.option("lineSep", "\nPredicted gene structure").text(path)
    body = F.regexp_extract("value", r"(?s)^(.*?)\nMATCH\s", 1)
    exon = r"(?m)^\s*Exon\s+\d+\s+(\d+)\s+(\d+)\b.*?score:\s+(\S+)\s*$"
    rows = rows.select(F.regexp_extract("value", r"(?m)^MATCH\s+\S+\s+(\S+)[+-]", 1).alias("ref"), body.alias("body")).where("ref <> '' AND body <> ''")
    scores = F.transform(F.regexp_extract_all("body", F.lit(exon), F.lit(3)), lambda s: s.cast("double"))
    return rows.select("ref", _pairs(F.col("body"), exon).alias("exons"), scores.alias("scores")).where(F.size("exons") > 0)


def read_text_locations(spark: SparkSession, path: str) -> DataFrame:
    """(pgl, ref, exons, orf, peptide) of plain text: a record runs from one line that begins with 'PGL' to the next."""
    rows = spark.read.option("lineSep", "\nPGL").text(path).select("value", F.input_file_name().alias("file"))
    serial = F.regexp_extract("value", r"^\s+(\d+)\s", 1)
    frames = "Maximal non-overlapping open reading frames"
    rows = rows.where((serial != "") & F.col("value").contains("\n  PGS")).select(F.concat("file", F.lit("#"), serial).alias("pgl"), F.substring_index("value", frames, 1).alias("head"), F.regexp_extract("value", f"(?s){frames}[^\\n]*\\n(.*)$", 1).alias("tail"))
    first = F.regexp_extract("tail", r"(?s)^\s*(>[^\n]*\(frame[^\n]*)\n(.*?)(?:\n\s*\n|$)", 1)
    protein = F.regexp_replace(F.regexp_extract("tail", r"(?s)^\s*(>[^\n]*\(frame[^\n]*)\n(.*?)(?:\n\s*\n|$)", 2), r"[\d\s]", "")
    lines = F.regexp_extract_all("head", F.lit(r"(?m)^(  PGS.*?\S+[+-])\s*$"), F.lit(1))
    rows = rows.select("pgl", F.nullif(F.trim(first), F.lit("")).alias("orf"), F.nullif(protein, F.lit("")).alias("peptide"), F.explode(lines).alias("line"))
    return rows.select("pgl", F.regexp_extract("line", r"(\S+)[+-]$", 1).alias("ref"), _pairs(F.col("line"), r"(\d+)\s+(\d+)(?=[,)])").alias("exons"), "orf", "peptide")


def _exons(exons: Column) -> Column:
    return F.transform(exons, lambda e: F.struct(e["_start"].alias("start"), e["_stop"].alias("stop")))


def read_xml_structures(spark: SparkSession, path: str) -> DataFrame:
    """(ref, exons, scores) of XML."""
    rows = spark.read.format("xml").option("rowTag", "predicted_gene_structure").schema(STRUCTURE).load(path)
    exons = F.col("`exon-intron_info`.exon")
    own = lambda e: F.struct(e["gDNA_exon_boundary"]["_g_start"].alias("start"), e["gDNA_exon_boundary"]["_g_stop"].alias("stop"))
    return rows.where(exons.isNotNull()).select(F.col("MATCH_line._ref_id").alias("ref"), F.transform(exons, own).alias("exons"), F.transform(exons, lambda e: e["reference_exon_boundary"]["_r_score"]).alias("scores"))


def read_xml_locations(spark: SparkSession, path: str) -> DataFrame:
    """(pgl, ref, exons, orf, peptide) of XML; the reading frame is the first one of the location."""
    rows = spark.read.format("xml").option("rowTag", "predicted_gene_location").schema(LOCATION).load(path)
    orf = F.get(F.filter(F.flatten(F.transform("AGS_information", lambda a: F.coalesce(a["three_phase_translation"]["probable_ORFs"]["orf_entry"], F.array()))), lambda o: o.isNotNull()), F.lit(0))
    rows = rows.select(F.concat(F.input_file_name(), F.lit("#"), F.col("PGL_line._PGL_serial")).alias("pgl"), "AGS_information", orf.alias("o"))
    # The frame's id and exons stand in an id_line, the exons there in orf_info; or both without one.
    exons = F.coalesce(F.col("o.id_line.orf_info.exon_boundaries.exon"), F.col("o.id_line.exon_boundaries.exon"), F.col("o.exon_boundaries.exon"))
    gdna = F.coalesce(F.col("o.id_line.gDNA"), F.col("o.gDNA"))
    bounds = F.array_join(F.transform(exons, lambda e: F.concat(e["_start"].cast("string"), F.lit("  "), e["_stop"].cast("string"))), ",")
    head = F.when(F.col("o").isNotNull(), F.concat(F.lit(">"), gdna["_id"], gdna["_strand"], F.lit(" ("), bounds, F.lit(")")))
    lines = F.flatten(F.transform("AGS_information", lambda a: F.coalesce(a["supporting_evidence"]["PGS_line"], F.array())))
    rows = rows.select("pgl", head.alias("orf"), F.col("o.predicted_protein_sequence").alias("peptide"), F.explode(lines).alias("l"))
    return rows.select("pgl", F.coalesce("l.referenceDNA._id", "l.referenceProtein._id").alias("ref"), _exons(F.col("l.gDNA_exon_coordinates.exon")).alias("exons"), "orf", "peptide")
