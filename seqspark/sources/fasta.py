"""Sequence files and headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records as (seq_id, descr, seq, len); descr keeps its leading '>'. Records may span lines."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    rows = raw.select(record.alias("r")).where("trim(r) <> ''")
    head = F.rtrim(F.substring_index("r", "\n", 1))
    rest = F.when(F.instr("r", "\n") > 0, F.expr("substring(r, instr(r, '\n') + 1)")).otherwise("")
    rows = rows.select(head.alias("head"), F.regexp_replace(rest, r"\s", "").alias("seq"))
    return rows.select(F.split("head", r"\s+")[0].alias("seq_id"), F.concat(F.lit(">"), "head").alias("descr"), "seq", F.length("seq").alias("len"))


def fasta_lines(df: DataFrame, width: int = 60) -> DataFrame:
    """(value): each record of df(descr, seq) as wrapped FASTA text."""
    head = F.when(F.col("descr").startswith(">"), F.col("descr")).otherwise(F.concat(F.lit(">"), "descr"))
    return df.select(F.concat(head, F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    fasta_lines(df, width).write.text(path)


def tabular(df: DataFrame) -> DataFrame:
    """df(descr, seq) as text rows 'SEQ *** description', upper-case."""
    return df.select(F.concat(F.upper("seq"), F.lit(" *** "), "descr").alias("value"))


def from_tabular(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r" \*\*\* ", 2)
    return lines.select(parts[1].alias("descr"), parts[0].alias("seq"))


def parse_ncbi_location(descr: Column) -> Column:
    """struct(contig, strand, exons) of '>lcl|CONTIG_cds...[location=...]'; null for partial or single-base places."""
    where = F.regexp_extract(descr, r"\[location=([^\]]*)\]", 1)
    contig = F.regexp_extract(descr, r"lcl\|(.+?)_cds", 1)
    pairs = F.regexp_extract_all(where, F.lit(r"(\d+\.\.\d+)"), 1)
    exons = F.transform(pairs, lambda p: F.struct(F.split(p, r"\.\.")[0].cast("int").alias("start"), F.split(p, r"\.\.")[1].cast("int").alias("stop")))
    strand = F.when(where.startswith("complement"), "-").otherwise("+")
    bare = F.regexp_replace(where, r"(complement|join|[()]|\d+\.\.\d+)", "")
    fine = (where != "") & ~where.rlike("[<>-]") & bare.rlike("^,*$") & (F.size(pairs) > 0)
    return F.when(fine, F.struct(contig.alias("contig"), strand.alias("strand"), exons.alias("exons")))


def parse_orf_header(descr: Column) -> Column:
    """struct(contig, strand, exons) of '>contig+ (start  stop,start  stop)'."""
    inside = F.transform(
        F.regexp_extract_all(F.regexp_extract(descr, r"\(([^)]*)\)", 1), F.lit(r"(\d+\s+\d+)"), 1),
        lambda p: F.struct(F.split(p, r"\s+")[0].cast("int").alias("start"), F.split(p, r"\s+")[1].cast("int").alias("stop")),
    )
    return F.struct(F.regexp_extract(descr, r"^>?(\S+)([+-])", 1).alias("contig"), F.regexp_extract(descr, r"^>?(\S+)([+-])", 2).alias("strand"), inside.alias("exons"))


def strip_version(seq_id: Column) -> Column:
    return F.regexp_replace(seq_id, r"\.\d+$", "")


def contig_store(seqs: DataFrame, chunk: int = 12_288, overlap: int = 4_096) -> DataFrame:
    """Contigs (contig_id, seq) as rows (contig_id, chunk_no, n, seq): chunk_no from 0 on, n the length of the contig, seq
    the chunk and the first overlap bases of the next. A giant contig is many rows under many keys, and a
    slice of up to overlap bases needs one of them. Work is linear: chunks are cut from parts of 256 of them."""
    step = chunk * 256

    def cut(rows: DataFrame, size: int, most: Column) -> DataFrame:
        count = F.greatest(F.lit(1), F.ceil(F.least(most, F.col("n") - F.col("at")) / size)).cast("int")
        part = lambda k: F.struct((F.col("at") + k * size).alias("at"), F.substring("seq", (k * size + 1).cast("int"), F.lit(size + overlap)).alias("seq"))
        return rows.select("contig_id", "n", F.explode(F.transform(F.sequence(F.lit(0), count - 1), part)).alias("x")).select("contig_id", "n", "x.*")

    rows = seqs.select("contig_id", F.length("seq").alias("n"), F.lit(0).cast("long").alias("at"), "seq")
    rows = cut(cut(rows, step, F.col("n")), chunk, F.lit(step))
    return rows.select("contig_id", F.floor(F.col("at") / chunk).cast("int").alias("chunk_no"), "n", "seq")


def gff_lines(features: DataFrame) -> DataFrame:
    """features(contig, feature, start, stop, strand, frame, kind, gene) as nine-column text rows."""
    group = F.concat(F.lit("src="), "kind", F.lit(";grp=gene."), F.col("gene").cast("string"), F.lit(";pri=10"))
    lo, hi = F.least("start", "stop"), F.greatest("start", "stop")
    return features.select(F.concat_ws("\t", "contig", F.lit("seqspark"), "feature", lo.cast("string"), hi.cast("string"), F.lit("."), "strand", "frame", group).alias("value"))


def parse_orf_text(spark: SparkSession, path: str) -> DataFrame:
    """Predicted reading frames in alignment text, (seq_id, descr, seq, len): digits and blanks go."""
    rows = read_fasta(spark, path)
    seq = F.regexp_replace("seq", r"[\d\s]", "")
    return rows.select("seq_id", "descr", seq.alias("seq"), F.length(seq).alias("len"))


def featvec_lines(features: DataFrame) -> DataFrame:
    """features(label, site_ratio, mcratio) as text rows '(+;<site_ratio,mcratio>)'."""
    return features.select(F.format_string("(%s;<%.6f,%.6f>)", "label", "site_ratio", "mcratio").alias("value"))


def parse_featvecs(lines: DataFrame) -> DataFrame:
    part = lambda k: F.regexp_extract("value", r"^\(([+-]);<([^,]+),([^>]+)>\)$", k)
    rows = lines.select(part(1).alias("label"), part(2).alias("site_ratio"), part(3).alias("mcratio")).where("label <> ''")
    return rows.select("label", F.col("site_ratio").cast("double"), F.col("mcratio").cast("double"))
