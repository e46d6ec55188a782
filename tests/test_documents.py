"""Annotated documents, written and read; rejects and their reasons."""

import glob
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from seqspark.functions import seq as S
from seqspark.operators import sites, structure
from seqspark.sources import alignments, xml

FRAMES = "gdna_id string, strand string, pgl long, ags long, pps long, frame int, exons array<struct<start: long, stop: long>>, n_nt long, n_aa long, peptide string"
FRAME = """<orf_entry><id_line><gDNA id="chr1" strand="{s}"/><serials PGL_serial="{g}" AGS_serial="1" PPS_serial="{p}"/><orf_info><exon_boundaries><exon start="90" stop="61"/><exon start="50" stop="21"/></exon_boundaries>
<frame>2</frame><number_coding_nucleotides>60</number_coding_nucleotides><number_encoded_amino_acids>19</number_encoded_amino_acids></orf_info></id_line><predicted_protein_sequence>MA*</predicted_protein_sequence>{a}</orf_entry>"""


def frames(spark):
    rows = [("c1", "+", 1, 1, 2, 0, [(10, 40)], 31, 10, "MB"), ("c1", "+", 1, 1, 1, 1, [(5, 40), (60, 90)], 67, 22, "M<&>"), ("c2", "-", 2, 1, 1, 2, [(90, 10)], 81, 27, None), ("c3", "+", None, None, None, 0, [(1, 9)], 9, 3, ""), ("c3", "+", None, None, None, 0, [(1, 9)], 9, 3, "")]
    return spark.createDataFrame(rows, FRAMES).withColumn("gene", F.monotonically_increasing_id())


def test_nested_frames_are_read(spark, tmp_path):
    notes = '<note method="x" orf_amino_bound="90" start_codon="87" stop_codon="23" best_TIS_score="-1.5" Met_seen_p="1"/><note method="y" orf_amino_bound="90" start_codon="90" stop_codon="23"/>'
    text = "<r><probable_ORFs xmlns='http://u/'>" + FRAME.format(s="-", g=7, p=1, a=notes) + FRAME.format(s="-", g=7, p=2, a="") + "</probable_ORFs><probable_ORFs><none/></probable_ORFs></r>"
    (tmp_path / "o.xml").write_text(text)
    got = xml.read_gth_orfs(spark, str(tmp_path / "o.xml"), annot="note").orderBy("pps").collect()
    assert [(r["gdna_id"], r["strand"], r["pgl"], r["pps"], r["frame"], r["n_nt"], r["n_aa"], r["peptide"]) for r in got] == [("chr1", "-", 7, p, 2, 60, 19, "MA*") for p in (1, 2)]
    assert [tuple(e) for e in got[0]["exons"]] == [(90, 61), (50, 21)]
    assert [tuple(a) for a in got[0]["annots"]] == [("x", 90, 87, 23, -1.5, True), ("y", 90, 90, 23, None, None)] and got[1]["annots"] == []
    first = xml.read_gth_orfs(spark, str(tmp_path / "o.xml"), first_only=True, annot="note").collect()
    assert [(r["pps"], len(r["annots"])) for r in first] == [(1, 2)]


def test_frames_round_trip(spark, tmp_path):
    rows = frames(spark)
    hits = rows.where("pgl = 1").select("gene", F.lit(5).alias("orf_amino_bound"), F.lit(8).alias("start_codon"), F.lit(38).alias("stop_codon"), F.lit(1e-7).alias("score"), F.lit(False).alias("met_seen"))
    noted = structure.annotate(structure.annotate(rows, hits, "one"), hits, "two").drop("gene")
    xml.write_gth_orfs(noted, str(tmp_path / "o"))
    back = xml.read_gth_orfs(spark, str(tmp_path / "o"))
    assert back.columns == noted.columns
    plain = lambda df: sorted(str(r.asDict(recursive=True)).replace("''", "None") for r in df.collect())
    assert plain(back) == plain(noted)
    for f in glob.glob(str(tmp_path / "o" / "part-*")):
        assert ET.parse(f).getroot().tag == "reading_frames"
    firsts = xml.read_gth_orfs(spark, str(tmp_path / "o"), first_only=True).collect()
    assert sorted((r["gdna_id"], str(r["pps"])) for r in firsts) == [("c1", "1"), ("c2", "1"), ("c3", "None"), ("c3", "None")]
    xml.write_gth_orfs(frames(spark).drop("gene"), str(tmp_path / "bare"))
    assert xml.read_gth_orfs(spark, str(tmp_path / "bare")).where("size(annots) = 0").count() == 5
    xml.write_gth_orfs(noted.limit(0), str(tmp_path / "none"))
    assert xml.read_gth_orfs(spark, str(tmp_path / "none")).count() == 0


def test_isoforms_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("l1", 1, 0.9, [(1, 9), (20, 30)]), ("l1", 2, 1e-4, [(3, 9)]), ("l2", 1, None, [(5, 50)])], "locus_id string, serial long, score double, exons array<struct<start: long, stop: long>>")
    hits = spark.createDataFrame([("l1", 1, 1, 4, 28, 2.5, True)], "locus_id string, serial long, orf_amino_bound long, start_codon long, stop_codon long, score double, met_seen boolean")
    gene = F.concat_ws("#", "locus_id", F.col("serial").cast("string"))
    noted = structure.annotate(rows.withColumn("gene", gene), hits.withColumn("gene", gene), "m").drop("gene")
    xml.write_pasif(noted, str(tmp_path / "p"))
    back = xml.read_pasif_isoforms(spark, str(tmp_path / "p"))
    assert sorted(map(str, back.collect())) == sorted(map(str, noted.collect()))
    flat = xml.read_pasif(spark, str(tmp_path / "p")).orderBy("locus_id", "serial", "exon_no").select("locus_id", "serial", "exon_no", "start", "stop")
    assert [tuple(r) for r in flat.collect()] == [("l1", 1, 1, 1, 9), ("l1", 1, 2, 20, 30), ("l1", 2, 1, 3, 9), ("l2", 1, 1, 5, 50)]


def test_locations_with_nested_frames_and_proteins(spark, tmp_path):
    text = """<r><predicted_gene_location><PGL_line PGL_serial="1"/><AGS_information><supporting_evidence><PGS_line><gDNA_exon_coordinates><exon start="101" stop="200"/></gDNA_exon_coordinates><referenceProtein id="p7"/></PGS_line></supporting_evidence>
    <three_phase_translation><probable_ORFs>""" + FRAME.format(s="-", g=1, p=1, a="") + "</probable_ORFs></three_phase_translation></AGS_information></predicted_gene_location></r>"
    (tmp_path / "l.xml").write_text(text)
    got = alignments.read_xml_locations(spark, str(tmp_path / "l.xml")).first()
    assert (got["ref"], got["orf"], got["peptide"]) == ("p7", ">chr1- (90  61,50  21)", "MA*")


def test_training_rejects_follow_the_checks_in_order(spark):
    def why(n, first, after, bound):
        if n < bound:
            return "short"
        if n < first + 2 + 3:
            return "first codon"
        if n - 2 - after < first:
            return "order"
        return "frame" if (n - after - first + 1) % 3 else None

    for first, after, bound in ((102, 99, 97), (1, 0, 9), (6, 1, 11)):
        rows = spark.range(0, 260).select("id", S.training_reject(F.col("id"), first, after, bound).alias("r")).collect()
        assert [r["r"] for r in rows] == [why(r["id"], first, after, bound) for r in rows]


def test_splice_report_keeps_every_gene(spark):
    contigs = spark.createDataFrame([("c", "CCATGAAATTTGG")], "contig_id string, seq string")
    rows = [(1, "c", "+", 1, 3, 8), (2, "c", "+", 1, 2, 8), (3, "c", "+", 1, 1, 8), (4, "d", "+", 1, 3, 8), (5, "c", "+", 1, 5, 12)]
    exons = spark.createDataFrame(rows, "gene long, contig_id string, strand string, exon_no int, start long, stop long")
    got = {r["gene"]: (r["seq"], r["reason"]) for r in structure.splice_report(exons, contigs, 1, 2, require_start=True).collect()}
    assert got == {1: ("CATGAAATT", None), 2: ("CCATGAAATT", "start"), 3: (None, "contig"), 4: (None, "contig"), 5: (None, "contig")}
    free = {r["gene"]: r["reason"] for r in structure.splice_report(exons, contigs, 1, 2).collect()}
    assert free == {1: None, 2: None, 3: "contig", 4: "contig", 5: "contig"}


def test_report_says_why_there_is_no_start(spark):
    seqs = spark.createDataFrame([(1, 500), (2, 500), (3, 500), (4, 10)], "seq_id long, n int")
    best = spark.createDataFrame([(1, 102, 3.0), (2, -1, -2.0)], "seq_id long, tis int, score double")
    got = {r["seq_id"]: (r["tis"], r["reason"]) for r in sites.tis_report(seqs, best, F.when(F.col("n") < 350, "short")).collect()}
    assert got == {1: (102, None), 2: (-1, "score"), 3: (-1, "no site"), 4: (-1, "short")}
