"""Hand-checked small cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from seqspark.functions import seq as S
from seqspark.operators import content, kmers, sampling, sites, structure, vectors
from seqspark.sources import fasta, xml


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_sequence_functions(spark):
    c = F.col("s")
    assert one(spark, S.revcomp(c), s="ACGTN") == "NACGT"
    assert one(spark, S.translate_cds(c), s="ATGTAAGGNAC") == "M-X?"
    assert one(spark, S.translate_cds(c), s="") == ""
    assert one(spark, S.normalize_seq(c), s="acgun") == "ACGTN"
    assert one(spark, S.normalize_seq(c, "reject"), s="acgun") is None
    seeded = one(spark, S.normalize_seq(c, "seeded"), s="acgunn")
    assert seeded[:4] == "ACGT" and set(seeded) <= set("ACGT") and seeded == one(spark, S.normalize_seq(c, "seeded"), s="acgunn")
    assert one(spark, S.hamming(c, F.lit("ACGA")), s="ACCT") == 2
    assert one(spark, S.subseq(c, F.lit(2), F.lit(2), F.lit("-")), s="ACGT") == "G"
    assert one(spark, S.subseq(c, F.lit(4), F.lit(3), F.lit("-")), s="ACGT") == "AC"
    assert one(spark, S.subseq(c, F.lit(0), F.lit(3), F.lit("+")), s="ACGT") is None
    assert one(spark, S.subseq(c, F.lit(3), F.lit(5), F.lit("+")), s="ACGT") is None
    assert one(spark, S.log_or_inf(F.lit(0.0))) == -math.inf
    assert one(spark, S.clip_to_tis(c, F.lit(102)), s="N" * 101 + "ATGAAA" + "N" * 99) == "ATGAAA"
    assert one(spark, S.canonical_start_stop(c), s="N" * 101 + "ATGAAATAA" + "N" * 99) is True


def test_candidates_need_fifty_codons_and_ties_take_the_first(spark):
    body = "ATG" + "GCC" * 10 + "ATG" + "GCC" * 60
    df = spark.createDataFrame([(1, "C" * 101 + body + "C" * 99), (2, "C" * 101 + "GCC" * 70 + "C" * 99), (3, "C" * 101 + body + "C" * 98)], "seq_id long, seq string")
    found = sites.met_sites(df)
    assert [tuple(r)[:2] for r in found.orderBy("seq_id", "pos").collect()] == [(1, 102), (1, 135)]
    assert sites.candidates(found).count() == 2
    short = spark.createDataFrame([(1, "C" * 101 + "GCC" * k + "ATG" + "GCC" * 49 + "C" * 99) for k in (1,)] + [(2, "C" * 101 + "GCC" + "ATG" + "GCC" * 48 + "C" * 99)], "seq_id long, seq string")
    assert [r["seq_id"] for r in sites.candidates(sites.met_sites(short)).collect()] == [1]
    scored = found.withColumn("llkr", F.lit(1.0))
    assert sites.predict_llkr(scored).first()["tis"] == 102
    assert sites.predict_llkr(scored.withColumn("llkr", F.lit(-0.5))).first()["tis"] == -1


def test_wam_rows(spark):
    df = spark.createDataFrame([("T", "AAAAAATGCCC")] * 3 + [("T", "ACAAAATGCCC")], "hyp string, site string")
    p = {(r["pos"], r["prev"], r["base"]): r["p"] for r in sites.train_wam(df, ["hyp"]).collect()}
    assert len(p) == 164
    assert p[1, "A", "A"] == pytest.approx(0.75 * 0.8 + 0.05) and p[1, "A", "G"] == 0.05 and p[1, "T", "C"] == 0.25
    assert (p[5, "G", "A"], p[6, "A", "T"], p[6, "C", "T"], p[7, "T", "G"], p[8, "A", "C"]) == (1, 1, 0, 1, 0)
    assert p[8, "G", "C"] == pytest.approx(0.85)
    assert sites.verify_pmf(sites.train_wam(df, ["hyp"]), ["hyp", "pos", "prev"]).where("pos NOT IN (6, 7)").count() == 0


def test_nearest_medoid_takes_the_lowest_of_equals(spark):
    med = spark.createDataFrame([(2, "AAC"), (1, "AAG"), (3, "TTT")], "cluster int, site string")
    got = sites.nearest_medoid(spark.createDataFrame([("AAA",), ("TTA",)], "site string"), med).collect()
    assert sorted((r["site"], r["cluster"], r["dist"]) for r in got) == [("AAA", 1, 1), ("TTA", 3, 1)]


def test_kmedoids_finds_two_groups(spark):
    df = spark.createDataFrame([("AAAA",)] * 5 + [("AAAT",)] + [("GGGG",)] * 4 + [("GGGC",)], "site string")
    got = sites.kmedoids(df, 2).collect()
    assert sorted(r["site"] for r in got) == ["AAAA", "GGGG"] and got[0]["error"] == 2
    with pytest.raises(ValueError):
        sites.kmedoids(df, 5)


def test_chi2_series(spark):
    assert one(spark, kmers.chi2_confidence(F.lit(3.0))) == pytest.approx(0.6083748237, abs=1e-9)
    assert one(spark, kmers.chi2_confidence(F.lit(0.0))) == 0


def test_interpolated_chain_sums_to_one(spark):
    df = spark.createDataFrame([(k, "ACGGTTAC" * 40 + "ATTTGC" * k) for k in range(12)], "seq_id long, seq string")
    chain = kmers.train_chi2_imm(kmers.count_kmers(df, F.pmod(F.col("i"), F.lit(3))))
    sums = chain.groupBy("model", "k", "hist").agg(F.sum("p").alias("s"), F.min("p").alias("m"))
    assert sums.where("abs(s - 1) > 0.02 OR m < 0").count() == 0
    assert sums.count() == 3 * sum(4**k for k in range(6))


GENE = [(1, "c", "+", 1, 11, 20), (1, "c", "+", 2, 31, 40), (2, "c", "-", 1, 40, 31), (2, "c", "-", 2, 20, 20)]


def exons(spark, rows=GENE):
    return spark.createDataFrame(rows, "gene long, contig_id string, strand string, exon_no int, start int, stop int")


def test_structures(spark):
    contig = spark.createDataFrame([("c", "ACGTACGTAA" + "ATGCCCAAAG" + "GTCCCCCCAG" + "TTTTTTTTAA" + "CC")], "contig_id string, seq string")
    e = exons(spark)
    assert {r["gene"]: r["seq"] for r in structure.splice(e, contig).collect()} == {1: "ATGCCCAAAGTTTTTTTTAA", 2: "TTAAAAAAAAC"}
    assert sorted(map(tuple, structure.introns(e).select("gene", "start", "stop").collect())) == [(1, 21, 30), (2, 30, 21)]
    assert sorted((r["gene"], r["phase"], r["after"]) for r in structure.exon_phase(e).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2)]
    assert sorted((r["gene"], r["start"], r["stop"]) for r in structure.trim_structure(e, 8, 5).collect()) == [(1, 19, 20), (1, 31, 33), (2, 20, 20), (2, 32, 31)]
    assert structure.splice(structure.with_flanks(e, 11, 1), contig).count() == 0
    assert all(r["ok"] for r in structure.structure_ordered(e).collect())
    assert [r["position"] for r in structure.genomic_position(e, spark.createDataFrame([(1, 12), (2, 1)], "gene long, at int")).orderBy("gene").collect()] == [32, 40]
    features = structure.anchors(e, contig)
    assert {r["gene"]: r["ok"] for r in structure.gene_grammar_ok(features).collect()} == {1: True, 2: False}
    kept = structure.sift(features, structure.hints(e)).select("gene", "feature").distinct().collect()
    assert {r["feature"] for r in kept if r["gene"] == 1} == {"exonpart", "start", "intronpart", "dss", "ass", "stop"} and {r["feature"] for r in kept if r["gene"] == 2} == {"CDSpart"}


def test_longest_orf_and_dedupe(spark):
    df = spark.createDataFrame([(1, "AB-CDE-FGH-"), (2, "---"), (3, "")], "seq_id long, peptide string")
    got = {r["seq_id"]: (r["piece"], r["begin_at"]) for r in structure.longest_orf(df, "seq_id").collect()}
    assert got == {1: ("CDE", 3), 2: ("", 0), 3: ("", 0)}
    df = spark.createDataFrame([("a", "AC"), ("b", "AC"), ("c", "G")], "descr string, seq string")
    assert {r["seq"]: r["descr"] for r in structure.dedupe_sequences(df).collect()} == {"AC": "b AND a", "G": "c"}


def test_sequence_classes(spark):
    df = spark.createDataFrame([("b", "AC", 1), ("a", "AC", 2), ("c", "G", 3), ("d", None, 4), ("e", None, 5), ("f", "", 6), ("b", "AC", 1)], "descr string, seq string, n int")
    got = sorted(map(tuple, structure.sequence_classes(df).collect()))
    assert got == [("a", 2, "a", 3), ("b", 1, "a", 3), ("b", 1, "a", 3), ("c", 3, "c", 1), ("d", 4, "d", 1), ("e", 5, "e", 1), ("f", 6, "f", 1)]
    assert structure.sequence_classes(df.where("false")).collect() == []


def test_rejects_of_columns(spark):
    df = spark.createDataFrame([(1, "AXxC"), (2, "ACGT"), (3, ""), (4, None)], "k int, seq string")
    assert [r[0] for r in df.orderBy("k").select(S.mask_reject(F.col("seq"), 0.25)).collect()] == ["masked", None, "empty", "empty"]
    whole = "A" * 101 + "ATG" + "CCC" + "TAA" + "A" * 99
    df = spark.createDataFrame([(1, whole), (2, whole.replace("ATG", "ATC")), (3, whole.replace("TAA", "TCA"))], "k int, seq string")
    assert [r[0] for r in df.orderBy("k").select(S.canonical_reject(F.col("seq"))).collect()] == [None, "start", "stop"]


def test_sampling(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    assert sampling.sample_without_replacement(df, "k", 5).count() == 5
    with pytest.raises(ValueError):
        sampling.sample_without_replacement(df, "k", 21)
    found, missing = sampling.extract_by_id(df, spark.createDataFrame([(3,), (30,)], "k long"), "k")
    assert [r["k"] for r in found.collect()] == [3] and [r["k"] for r in missing.collect()] == [30]
    with pytest.raises(ValueError):
        sampling.extract_by_id(df.union(df), df, "k")
    with pytest.raises(ValueError):
        sampling.route_by_cluster(spark.createDataFrame([("A",)], "site string"), spark.createDataFrame([("C", 1)], "site string, cluster int"))


def test_distances(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(F.lit(2.0), F.lit(None).cast("double"), F.lit(5.0))
    assert one(spark, vectors.distance(a, b)) == 2.5
    assert one(spark, vectors.distance(a, b, "cityblock")) == 1.5
    assert one(spark, vectors.distance(a, F.array(*map(F.lit, (-1.0, -2.0, -3.0))), "correlation")) == pytest.approx(2)
    assert one(spark, vectors.distance(a, F.array(*map(F.lit, (-1.0, -2.0, -3.0))), "absolute correlation")) == pytest.approx(0)


def test_linear_unit_fits_a_plane(spark):
    df = spark.createDataFrame([(float(x), float(y), 1 + 2.0 * x - 3.0 * y) for x in range(4) for y in range(4)], "x double, y double, target double")
    assert tuple(sites.linear_unit(df).first()) == pytest.approx((1, 2, -3))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first > record\nACG\nT T\n>two\n>three x\nGG\n")
    rows = {r["seq_id"]: (r["descr"], r["seq"], r["len"]) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert rows == {"one": (">one first > record", "ACGTT", 5), "two": (">two", "", 0), "three": (">three x", "GG", 2)}
    long = spark.createDataFrame([(">x", "A" * 130)], "descr string, seq string")
    fasta.write_fasta(long, str(tmp_path / "out"))
    back = fasta.read_fasta(spark, str(tmp_path / "out")).first()
    assert back["seq"] == "A" * 130 and max(map(len, fasta.fasta_lines(long).first()["value"].split("\n"))) == 60
    assert fasta.from_tabular(fasta.tabular(long)).first()["seq"] == "A" * 130
    assert fasta.contig_store(spark.createDataFrame([("c", "ACGT" * 10)], "contig_id string, seq string"), 16, 4).count() == 3


def test_headers(spark):
    exons = lambda x: [tuple(e) for e in x["exons"]]
    got = one(spark, fasta.parse_orf_header(F.col("s")), s=">contig.593- (231423  231190,229816  229646)")
    assert (got["contig"], got["strand"], exons(got)) == ("contig.593", "-", [(231423, 231190), (229816, 229646)])
    got = one(spark, fasta.parse_ncbi_location(F.col("s")), s=">lcl|NW_1.1_cds_XP_2 [location=complement(join(5..9,20..31))] [x=y]")
    assert (got["contig"], got["strand"], exons(got)) == ("NW_1.1", "-", [(5, 9), (20, 31)])
    assert one(spark, fasta.parse_ncbi_location(F.col("s")), s=">lcl|C_cds_1 [location=<5..9]") is None
    assert one(spark, fasta.parse_ncbi_location(F.col("s")), s=">lcl|C_cds_1 [location=join(5,7..9)]") is None


def test_documents(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<PASIF><locus id="L1"><isoform serial="1" score="0.5"><exon start="3" stop="9"/><exon start="20" stop="31"/></isoform></locus><locus id="L2"><none/></locus></PASIF>')
    got = sorted(map(tuple, xml.read_pasif(spark, str(tmp_path / "p.xml")).collect()))
    assert got == [("L1", 1, 0.5, 1, 3, 9), ("L1", 1, 0.5, 2, 20, 31)]
    (tmp_path / "m.xml").write_text('<x><kmedoids stringsize="3" k="2" error="4"><medoid id="1">AAA</medoid><medoid id="2">CCC</medoid></kmedoids></x>')
    assert sorted((r["cluster"], r["site"]) for r in xml.read_medoids(spark, str(tmp_path / "m.xml")).collect()) == [(1, "AAA"), (2, "CCC")]
    (tmp_path / "w.xml").write_text('<x><kmedoids stringsize="3" k="3" error="4"><medoid id="1">AAA</medoid><medoid id="2">CCC</medoid></kmedoids></x>')
    with pytest.raises(ValueError):
        xml.read_medoids(spark, str(tmp_path / "w.xml"))


def test_predicted_frames_and_curated_models(spark, tmp_path):
    orf = """<x><orf_entry><gDNA id="c1" strand="-"/><serials PGL_serial="1" AGS_serial="2" PPS_serial="3"/><orf_info><exon_boundaries><exon start="90" stop="61"/><exon start="50" stop="21"/></exon_boundaries>
    <frame>1</frame><number_coding_nucleotides>60</number_coding_nucleotides><number_encoded_amino_acids>19</number_encoded_amino_acids></orf_info><predicted_protein_sequence>MA*</predicted_protein_sequence></orf_entry></x>"""
    (tmp_path / "o.xml").write_text(orf)
    got = xml.read_gth_orfs(spark, str(tmp_path / "o.xml")).first()
    assert (got["gdna_id"], got["strand"], got["pgl"], got["ags"], got["pps"], got["n_nt"], got["n_aa"], got["peptide"]) == ("c1", "-", 1, 2, 3, 60, 19, "MA*")
    assert [tuple(e) for e in got["exons"]] == [(90, 61), (50, 21)]
    part = lambda a, b: f"<EXON><CDS><COORDSET><END5>{a}</END5><END3>{b}</END3></COORDSET></CDS></EXON>"
    model = lambda name, curated, n, exons: f'<MODEL CURATED="{curated}"><FEAT_NAME>{name}</FEAT_NAME>{exons}<PROTEIN_SEQUENCE>{"M" * n}*</PROTEIN_SEQUENCE></MODEL>'
    (tmp_path / "t.xml").write_text("<x>" + model("m1", 1, 100, part(1, 30) + "<EXON></EXON>" + part(41, 70)) + model("m2", 0, 200, part(5, 9)) + model("m3", 1, 99, part(5, 9)) + "</x>")
    got = xml.read_tigr_models(spark, str(tmp_path / "t.xml")).orderBy("exon_no").collect()
    assert [tuple(r) for r in got] == [("m1", 1, 1, 30), ("m1", 2, 41, 70)]


def test_gff_lines_and_versions(spark):
    rows = spark.createDataFrame([("c", "CDSpart", 9, 2, "-", ".", "M", 7)], "contig string, feature string, start int, stop int, strand string, frame string, kind string, gene int")
    assert fasta.gff_lines(rows).first()[0] == "c\tseqspark\tCDSpart\t2\t9\t.\t-\t.\tsrc=M;grp=gene.7;pri=10"
    got = one(spark, fasta.strip_version(F.col("s")), s="AC037425.12")
    assert got == "AC037425"


def test_accepted_starts(spark):
    rows = spark.createDataFrame([(101 + 44, 100), (101 + 45, 100), (101 + 45, 1000)], "tis int, n int")
    assert [r[0] for r in rows.select(S.accept_tis(F.col("tis"), F.col("n"))).collect()] == [True, False, True]


def test_long_sequences_are_scanned_in_pieces(spark):
    import random
    import re
    import time

    random.seed(2)
    text = "".join(random.choices("ACGT", k=300_000))
    df = spark.createDataFrame([(1, text), (2, "ATG"), (3, "ACGTAATGCCA")], "seq_id long, seq string")
    began = time.time()
    got = sorted((r["strand"], r["pos"], r["site"]) for r in sites.all_frame_sites(df).where("seq_id = 1").collect())
    assert time.time() - began < 60
    turned = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    n = len(text)
    want = [("+", m.start() + 1, text[m.start() - 5 : m.start() + 6]) for m in re.finditer("ATG", text) if m.start() >= 5 and m.start() + 6 <= n]
    want += [("-", n - m.start(), turned[m.start() - 5 : m.start() + 6]) for m in re.finditer("ATG", turned) if m.start() >= 5 and m.start() + 6 <= n]
    assert got == sorted(want)
    assert [r["pos"] for r in sites.all_frame_sites(df).where("seq_id = 3").collect()] == [6]


def test_chi_square_far_out(spark):
    got = [r[0] for r in spark.createDataFrame([(7.815,), (99.0,), (500.0,), (1000.0,)], "x double").select(kmers.chi2_confidence(F.col("x"))).collect()]
    assert got[0] == pytest.approx(0.95, abs=1e-4) and got[1:] == pytest.approx([1, 1, 1])


def test_rank_metrics(spark):
    import random

    random.seed(6)
    a, b = [random.randint(0, 5) for _ in range(15)], [random.randint(0, 5) for _ in range(15)]
    got = spark.createDataFrame([(a, b)], "a array<int>, b array<int>").select(*(vectors.distance(F.col("a"), F.col("b"), m) for m in ("spearman", "kendall"))).first()
    rank = lambda x: [sum(w < v for w in x) + (x.count(v) + 1) / 2 for v in x]
    mean = 8.0
    ra, rb = rank(a), rank(b)
    r = sum((p - mean) * (q - mean) for p, q in zip(ra, rb, strict=True)) / math.sqrt(sum((p - mean) ** 2 for p in ra) * sum((q - mean) ** 2 for q in rb))
    sign = lambda x: (x > 0) - (x < 0)
    pairs = [(sign(a[i] - a[j]), sign(b[i] - b[j])) for i in range(15) for j in range(i)]
    tau = sum(u * v for u, v in pairs) / math.sqrt(sum(abs(u) for u, _ in pairs) * sum(abs(v) for _, v in pairs))
    assert got[0] == pytest.approx(1 - r) and got[1] == pytest.approx(1 - tau)


def test_kmeans_and_singular_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 5, 9)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    placed, centres = vectors.kmeans(df, "vec_id", "embedding", 3)
    by = {r["vec_id"]: r["cluster"] for r in placed.collect()}
    assert len(by) == 60 and all(len({by[20 * g + i] for i in range(20)}) == 1 for g in range(3)) and len(set(by.values())) == 3 and centres.count() == 3
    got = [r["value"] for r in vectors.singular_values(df, "embedding").orderBy("k").collect()]
    assert got == pytest.approx(list(np.linalg.svd(x, compute_uv=False)))


def test_balance_takes_the_first_by_hash(spark):
    import hashlib

    rows = [(i, "ab"[i % 2], i % 7 == 0) for i in range(300)] + [(i, "c", True) for i in range(300, 310)] + [(i, None, i % 3 == 0) for i in range(310, 330)] + [(i, "d", False) for i in range(330, 340)]
    got = sorted(tuple(r) for r in sampling.balance(spark.createDataFrame(rows, "k long, g string, pos boolean"), "pos", "k", "g").select("k", "pos").collect())
    want = []
    for g in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == g]
        n = sum(r[2] for r in own)
        negative = sorted((r for r in own if not r[2]), key=lambda r: hashlib.md5(f"{r[0]}s".encode()).hexdigest())[:n]
        want += [(r[0], r[2]) for r in own if r[2]] + [(r[0], False) for r in negative]
    assert got == sorted(want)


def test_slices_over_chunks_of_a_long_contig(spark):
    random.seed(12)
    seq = "".join(random.choices("ACGT", k=60_000))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    edge = structure.CHUNK
    spans = [(1, 60_000), (edge - 3, edge + 3), (edge, edge), (edge + 1, edge + 1), (5, edge + structure.OVERLAP + 9), (59_990, 60_000), (59_990, 60_001), (0, 4), (70_000, 70_010), (30_000, 35_000), (30_000, 35_000)]
    rows = [(k, "c", "-" if k % 2 else "+", *((b, a) if k % 2 else (a, b))) for k, (a, b) in enumerate(spans)] + [(99, "none", "+", 1, 5)]
    features = spark.createDataFrame(rows, "k int, contig_id string, strand string, start long, stop long")
    contigs = spark.createDataFrame([("c", seq), ("d", "ACGT")], "contig_id string, seq string")
    for source in (contigs, fasta.contig_store(contigs, structure.CHUNK, structure.OVERLAP)):
        got = {r["k"]: r["piece"] for r in structure.with_slices(features, source).collect()}
        for k, (a, b) in enumerate(spans):
            piece = seq[a - 1 : b]
            assert got[k] == ((turn(piece) if k % 2 else piece) if a >= 1 and b <= 60_000 else None)
        assert got[99] is None and len(got) == len(rows)
    wide = {r["k"]: (r["lead"], r["piece"]) for r in structure.with_slices(features, contigs, 50).collect()}
    for k, (a, b) in enumerate(spans):
        if a >= 1 and b <= 60_000:
            lo, hi = max(1, a - 50), min(60_000, b + 50)
            assert wide[k] == (hi - b if k % 2 else a - lo, turn(seq[lo - 1 : hi]) if k % 2 else seq[lo - 1 : hi])


def test_equal_long_features_stay_apart(spark):
    contigs = spark.createDataFrame([("c", "ACGT" * 5000)], "contig_id string, seq string")
    features = spark.createDataFrame([("g", "c", "+", 3, 9000)] * 3, "gene string, contig_id string, strand string, start long, stop long")
    assert [len(r["piece"]) for r in structure.with_slices(features, contigs).collect()] == [8998] * 3


def test_hexamers_and_gc_windows_of_long_sequences(spark):
    random.seed(13)
    seqs = {k: "".join(random.choices("ACGT", weights=w, k=n)) for k, (n, w) in enumerate([(300_000, (1, 1, 1, 1)), (5000, (1, 4, 1, 1)), (100, (3, 1, 1, 1)), (101, (1, 1, 1, 1)), (99, (1, 2, 2, 1)), (6, (1, 1, 1, 1)), (5, (1, 1, 1, 1)), (2048 + 5, (1, 1, 1, 1)), (2147, (1, 1, 1, 1))])}
    df = spark.createDataFrame(list(seqs.items()), "seq_id int, seq string")
    got = {}
    for r in kmers._windows(df, "seq_id").collect():
        got.setdefault(r["seq_id"], {})[r["i"]] = r["hexamer"]
    assert got == {k: {i: s[i : i + 6] for i in range(len(s) - 5)} for k, s in seqs.items() if len(s) > 5}
    bounds = [(1, 40), (2, 48), (3, 55), (4, 70)]
    table = spark.createDataFrame(bounds, "q int, bound int")
    bin_of = lambda s: next((q for q, b in bounds if b >= 100 * sum(c in "GC" for c in s) // len(s)), 4)
    for edges in (False, True):
        rows = {}
        for r in kmers.gc_hexamers(df, table, "seq_id", edges=edges).collect():
            rows.setdefault(r["seq_id"], {})[r["i"]] = (r["hexamer"], r["q"])
        for k, s in seqs.items():
            want = {}
            for i in range(len(s) - 5):
                if len(s) < 100:
                    want[i] = (s[i : i + 6], bin_of(s))
                elif edges or 47 <= i <= len(s) - 53:
                    w = min(max(i - 47, 0), len(s) - 100)
                    want[i] = (s[i : i + 6], bin_of(s[w : w + 100]))
            assert rows.get(k, {}) == want
    gc = {}
    for s in seqs.values():
        for w in [s[i : i + 100] for i in range(len(s) - 99)] if len(s) >= 100 else [s]:
            g = 100 * sum(c in "GC" for c in w) // len(w)
            gc[g] = gc.get(g, 0) + 1
    assert {r["gc"]: r["n"] for r in kmers.gc_windows(df).collect()} == gc


@pytest.mark.parametrize("kind", ["chi2", "deleted", "fixed"])
def test_trainers_by_bin_are_those_of_each_bin(spark, kind):
    random.seed(14)
    seqs = spark.createDataFrame([(k, "".join(random.choices("ACGT", weights=(1, 1 + k % 3, 1, 1), k=900))) for k in range(12)], "seq_id int, seq string")
    table = spark.createDataFrame([(1, 50), (2, 100)], "q int, bound int")
    counts = kmers.count_gc_kmers(seqs, table, F.lit(3)).cache()
    held = kmers.count_gc_kmers(seqs.where("seq_id % 2 = 0"), table, F.lit(3)).cache()
    train = {"chi2": kmers.train_chi2_imm, "deleted": kmers.train_deleted_interpolation, "fixed": kmers.train_fixed_order}[kind]
    own = (counts, held) if kind == "deleted" else (counts,)
    rows = lambda df: {tuple(r[c] for c in df.columns if c not in ("p", "q")): round(r["p"], 12) for r in df.collect()}
    both = kmers.train_by_bin(train, *own)
    for q in (1, 2):
        assert rows(both.where(F.col("q") == q)) == rows(train(*(c.where(F.col("q") == q).drop("q") for c in own)))


def test_widest_frames_on_a_long_contig(spark):
    random.seed(15)
    seq = "".join(random.choices("ACGT", k=40_000))
    genes = []
    for k in range(300):
        a = random.randint(1, 39_900)
        b = a + random.randint(2, 90)
        genes.append((k, "c", "+", a, b) if k % 2 else (k, "c", "-", b, a))
    genes += [(900, "c", "+", 0, 9), (901, "c", "+", 39_999, 40_001), (902, "none", "+", 50, 80), (903, "c", "+", 7, 8)]
    df = spark.createDataFrame(genes, "gene int, contig_id string, strand string, start long, stop long")
    got = {r["gene"]: (r["start"], r["stop"]) for r in content.maximal_orf(df, spark.createDataFrame([("c", seq)], "contig_id string, seq string")).collect()}
    want, n = {}, len(seq)
    for k, contig, strand, start, stop in genes:
        g = seq if strand == "+" else seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
        a, b = (start, stop) if strand == "+" else (n - start + 1, n - stop + 1)
        if contig != "c" or a < 1 or b > n or b - a < 2:
            continue
        stops = ("TAA", "TAG", "TGA")
        x = next((p + 3 for p in range(a - 3, 0, -3) if g[p - 1 : p + 2] in stops), a)
        y = next((p + 2 for p in range(b - 2, n - 1, 3) if g[p - 1 : p + 2] in stops), b)
        if x - 5 >= 1 and y + 3 <= n:
            want[k] = (x, y) if strand == "+" else (n - x + 1, n - y + 1)
    assert got == want
