"""Genes are worked out in one chunk of their contig; those that reach beyond it give the same."""

import glob

import pytest
from pyspark.sql import functions as F

from seqspark.operators import content, sites, structure
from seqspark.plans import queries as plans
from seqspark.plans import tables as T
from seqspark.sources import xml

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("whole_codons", [True, False])
def test_genes_in_chunks_and_beyond(spark, monkeypatch, whole_codons):
    wam = sites.train_wam(plans.training(spark, SF), ["hyp"])
    genes, contigs = T.genes(spark, SF), T.contigs(spark, SF)
    exons = T.exons(spark, SF).cache()
    long = content._predict_long(exons, contigs, wam, sites.predict_llkr, whole_codons)
    want = sorted(tuple(r) for r in long.select("gene", "orf_start", "score", "position").collect())
    assert len(want) > 1000 and any(r[2] is not None for r in want)
    again = []
    monkeypatch.setattr(content, "_predict_long", lambda *a, old=content._predict_long: (again.append(a[0].select("gene").distinct().count()), old(*a))[1])
    for rows, chunk, overlap in ((genes, structure.CHUNK, structure.OVERLAP), (exons, structure.CHUNK, structure.OVERLAP), (genes, 400, 1200)):
        monkeypatch.setattr(structure, "CHUNK", chunk)
        monkeypatch.setattr(structure, "OVERLAP", overlap)
        got = content.predict_structures(rows, contigs, wam, whole_codons=whole_codons)
        got = got.select("gene", "orf_amino_bound", "score", F.when(F.col("met_seen"), F.col("start_codon"))).collect()
        assert sorted(map(tuple, got)) == want
    assert len(again) == 1 and 0 < again[0] < len(want)  # small chunks leave some genes, not all


def test_genes_hold_the_exons_in_order(spark):
    genes = T.genes(spark, SF)
    assert genes.where("parts <> array_sort(parts)").isEmpty()
    assert genes.agg(F.sum(F.size("parts"))).first()[0] == T.read(spark, SF, "lineitem").count()


def test_documents_are_written_compressed(spark, tmp_path):
    rows = spark.range(20).selectExpr("'c' AS gdna_id", "'+' AS strand", "id AS pgl", "1L AS ags", "id AS pps", "0 AS frame", "array(struct(1L AS start, 9L AS stop)) AS exons", "9L AS n_nt", "3L AS n_aa", "'M<&*' AS peptide")
    xml.write_gth_orfs(rows, str(tmp_path / "o"), compression="gzip")
    files = glob.glob(str(tmp_path / "o" / "part-*"))
    assert files and all(f.endswith(".gz") for f in files)
    assert xml.read_gth_orfs(spark, str(tmp_path / "o")).where("peptide = 'M<&*'").count() == 20
