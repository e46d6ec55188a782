import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import content, vectors
from seqspark.sources import alignments

TEXT = """Header of the file

Predicted gene structure (within gDNA segment 1 to 900):

 Exon  1    101    200 ( 100 n);  cDNA      1    100 ( 100 n); score: 1.000
  Intron  1    201    300 ( 100 n); Pd: 0.999 (s: 1.00), Pa: 0.998 (s: 1.00)
 Exon  2    301    420 ( 120 n);  cDNA    101    220 ( 120 n); score: 0.980
 PPA                     cDNA    221    230

MATCH  chr1+ est7+ 0.99 220 1.0 C
PGS_chr1+_est7+ (101  200,301  420)

Predicted gene structure (within gDNA segment 1 to 900):

 Exon  1    700    640 (  61 n);  cDNA      1     61 (  61 n); score: 0.500

MATCH  chr1- est-8- 0.5 61 1.0 C

Predicted gene locations (2):

PGL   1 (+ strand):      101      420
AGS-1 (101  200,301  420)
  PGS (101  200,301  420)\test7+
  PGS (101  200)\test9+

Maximal non-overlapping open reading frames (>= 2 codons)

>chr1+_PGL-1_AGS-1_PPS_1 (110  200,301  400)\t(frame '1';    190 bp,   62 residues)
        1  MKV LLA
       61  TT

PGL   2 (- strand):      700      640
  PGS (700  640)\test-8-

Maximal non-overlapping open reading frames (>= 2 codons)
none
"""
XML = """<GTH_output xmlns="http://example.org/x"><alignment_module>
<predicted_gene_structure><exon-intron_info><exon e_serial="1"><gDNA_exon_boundary g_start="101" g_stop="200" g_length="100"/><reference_exon_boundary r_start="1" r_score="1.000"/></exon>
<intron i_serial="1"/><exon e_serial="2"><gDNA_exon_boundary g_start="301" g_stop="420" g_length="120"/><reference_exon_boundary r_start="2" r_score="0.980"/></exon></exon-intron_info><MATCH_line ref_id="est7" gen_id="chr1"/></predicted_gene_structure>
<predicted_gene_structure><exon-intron_info><exon e_serial="1"><gDNA_exon_boundary g_start="700" g_stop="640"/><reference_exon_boundary r_score="0.5"/></exon></exon-intron_info><MATCH_line ref_id="est-8"/></predicted_gene_structure>
</alignment_module><PGL_module>
<predicted_gene_location><PGL_line PGL_serial="1"/><AGS_information><supporting_evidence><PGS_line><gDNA_exon_coordinates><exon start="101" stop="200"/><exon start="301" stop="420"/></gDNA_exon_coordinates><referenceDNA id="est7"/></PGS_line>
<PGS_line><gDNA_exon_coordinates><exon start="101" stop="200"/></gDNA_exon_coordinates><referenceDNA id="est9"/></PGS_line></supporting_evidence>
<three_phase_translation><probable_ORFs><orf_entry><gDNA id="chr1" strand="+"/><exon_boundaries><exon start="110" stop="200"/><exon start="301" stop="400"/></exon_boundaries><predicted_protein_sequence>MKVLLATT</predicted_protein_sequence></orf_entry></probable_ORFs></three_phase_translation></AGS_information></predicted_gene_location>
<predicted_gene_location><PGL_line PGL_serial="2"/><AGS_information><supporting_evidence><PGS_line><gDNA_exon_coordinates><exon start="700" stop="640"/></gDNA_exon_coordinates><referenceDNA id="est-8"/></PGS_line></supporting_evidence><three_phase_translation><probable_ORFs><none/></probable_ORFs></three_phase_translation></AGS_information></predicted_gene_location>
</PGL_module></GTH_output>"""


@pytest.mark.parametrize("kind", ["text", "xml"])
def test_spliced_alignments(spark, tmp_path, kind):
    path = tmp_path / f"a.{kind}"
    path.write_text(TEXT if kind == "text" else XML)
    read = (alignments.read_text_structures, alignments.read_text_locations) if kind == "text" else (alignments.read_xml_structures, alignments.read_xml_locations)
    structures, locations = (f(spark, str(path)) for f in read)
    two = [(101, 200), (301, 420)]
    plain = lambda exons: [tuple(e) for e in exons]
    assert sorted((r["ref"], plain(r["exons"]), r["scores"]) for r in structures.collect()) == [("est-8", [(700, 640)], [0.5]), ("est7", two, [1.0, 0.98])]
    got = sorted((r["pgl"][-1], r["ref"], plain(r["exons"]), r["peptide"], r["orf"] is None) for r in locations.collect())
    assert got == [("1", "est7", two, "MKVLLATT", False), ("1", "est9", [(101, 200)], "MKVLLATT", False), ("2", "est-8", [(700, 640)], None, True)]
    kept = content.supported_structures(structures, locations, 2, 0.9).collect()
    assert [(r["ref"], plain(r["exons"]), r["orf"].split("(")[1].split(")")[0]) for r in kept] == [("est7", two, "110  200,301  400")]


def rows_of(n=230, size=6):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, size)) * 0.5
    x[100:130] = x[0] + rng.normal(size=(30, size)) * 0.05
    x[5] = x[6]
    return x


@pytest.fixture
def table(spark):
    rows = [(i, i % 3, [float(v) for v in r]) for i, r in enumerate(rows_of())] + [(900, 0, None), (901, 1, [None] * 6)]
    return spark.createDataFrame(rows, "k long, label int, v array<double>").repartition(5)


@pytest.mark.parametrize("metric", ["euclid", "cityblock", "correlation", "absolute correlation", "uncentred correlation", "absolute uncentred correlation", "spearman", "kendall"])
def test_nearest_is_brute_force_under_every_metric(spark, table, metric, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 50)
    whole = table.where("k < 900")
    got = {(r["a"], r["rank"]): (r["b"], round(r["dist"], 7)) for r in vectors.nearest(table, table.where("k % 40 = 0"), "k", "v", 4, metric).collect()}
    pairs = whole.where("k % 40 = 0").select(F.col("k").alias("a"), F.col("v").alias("x")).crossJoin(whole.select(F.col("k").alias("b"), F.col("v").alias("y"))).where("a <> b")
    want = {}
    for r in pairs.select("a", "b", F.round(vectors.distance(F.col("x"), F.col("y"), metric), 10).alias("d")).collect():
        want.setdefault(r["a"], []).append((r["d"], r["b"]))
    assert len(got) == 4 * len(want)
    for a, own in want.items():
        for k, (d, _) in enumerate(sorted(own)[:4], 1):
            assert got[a, k][1] == pytest.approx(d, abs=1e-6)


def test_density_weights_and_pairs_within_a_cutoff(table, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    x, cutoff = rows_of(), 0.02
    d = ((x[:, None] - x[None]) ** 2).mean(2)
    pairs = {(r["a"], r["b"]) for r in vectors.within(table, "k", "v", cutoff).collect()}
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and d[i, j] < cutoff}
    assert pairs == want and len(want) > 400
    for r in vectors.density_weights(table, "k", "v", cutoff, 2).collect():
        assert r["weight"] == pytest.approx(1 / (np.maximum(0, 1 - d[r["k"]] / cutoff) ** 2).sum())


def test_linkage(table, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 20)
    x = rows_of()
    label = np.arange(len(x)) % 3
    got = vectors.linkage(table, "label", "v").collect()
    assert len(got) == 3
    for r in got:
        a, b = x[label == r["a"]], x[label == r["b"]]
        d = ((a[:, None] - b[None]) ** 2).mean(2)
        assert [r[c] for c in ("smallest", "largest", "average")] == pytest.approx([d.min(), d.max(), d.mean()])
        assert r["means"] == pytest.approx(((a.mean(0) - b.mean(0)) ** 2).mean()) and r["medians"] == pytest.approx(((np.median(a, 0) - np.median(b, 0)) ** 2).mean())


def test_kmedians(table):
    placed, centres, converged = vectors.kmedians(table, "k", "v", 3)
    assert converged
    x = rows_of()
    c = {r["cluster"]: np.array(r["centre"]) for r in centres.collect()}
    rows = placed.collect()
    assert len(rows) == len(x)
    own = {r["k"]: r["cluster"] for r in rows}
    for r in rows:
        d = {i: np.abs(x[r["k"]] - m).mean() for i, m in c.items()}
        assert r["dist"] == pytest.approx(min(d.values())) and d[r["cluster"]] == pytest.approx(r["dist"])
    for i, m in c.items():
        members = x[[k for k, v in own.items() if v == i]]
        assert len(members) == 0 or m == pytest.approx(np.median(members, 0))


def test_no_vectors(table):
    none = table.where("k > 899")
    assert vectors.density_weights(none, "k", "v", 1.0, 1).collect() == []
    assert vectors.linkage(none, "label", "v").collect() == []
    assert vectors.kmedians(none, "k", "v", 2)[0].collect() == []
    assert vectors.nearest(none, none, "k", "v", 2).collect() == []
