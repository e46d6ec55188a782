"""Work inside tasks against the same work row by row, on odd rows too."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from seqspark.operators import arrays, content, kmers, sites, structure

ODD = [(1, "ACGTACGTNACGTACGT"), (2, "acgtacgtac"), (3, "ACGTACéGTACGTAC"), (4, None), (5, "ACG"), (6, ""), (1, "TTTTTTTTTT"), (None, "GATTACAGATTACA")]


def odd(spark):
    return spark.createDataFrame(ODD, "seq_id long, seq string")


def same(a, b):
    return sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_words_are_counted_as_row_by_row(spark):
    model = F.pmod(F.col("i"), F.lit(3)) + F.coalesce("seq_id", F.lit(9)) * 3
    ascii_only = odd(spark).where("seq_id IS NULL OR seq_id <> 3")
    own, plain = (kmers.count_hexamers(ascii_only, model, "seq_id", period=p) for p in (3, None))
    assert same(own.select("model", "hexamer", "n"), plain)


def test_partial_sums_are_few(spark):
    seqs = spark.createDataFrame([(k, "ACGGTTACCATG" * 40) for k in range(200)], "seq_id long, seq string").coalesce(2)
    assert arrays.count_words(seqs, [], 3).count() <= 2 * 12 * 3  # twelve words in three phases from each task, not 95,000


def test_words_by_gc_bin(spark):
    seqs = spark.createDataFrame([(k, "ACGGTTACCATG" * (6 + k) + "G" * 40 * k + "NNA" + "AT" * 30) for k in range(4)], "seq_id long, seq string")
    bounds = spark.createDataFrame([(1, 30), (2, 50), (3, 60)], "q int, bound int")
    model = F.pmod(F.col("i"), F.lit(3))
    own, plain = (kmers.count_gc_kmers(seqs, bounds, model, period=p) for p in (3, None))
    assert same(own, plain)
    chains = kmers.train_by_bin(kmers.train_fixed_order, own)
    table = {(r["q"], r["model"], r["hist"] + r["base"]): math.log(r["p"]) for r in chains.collect()}
    want: dict = {}
    for r in kmers.gc_hexamers(seqs, bounds, "seq_id", edges=True).collect():
        if (r["q"], r["i"] % 3, r["hexamer"]) in table:
            want[r["seq_id"]] = want.get(r["seq_id"], 0) + table[r["q"], r["i"] % 3, r["hexamer"]]
    got = {r["seq_id"]: r["loglik"] for r in kmers.gc_window_loglik(seqs, bounds, chains).collect()}
    assert got == pytest.approx(want)


def test_dynamic_loglik_of_repeated_and_null_keys(spark):
    seqs = odd(spark)
    counts = arrays.count_words(seqs, ["seq_id"], 3).where("hexamer RLIKE '^[ACGT]+$'").select((F.coalesce("seq_id", F.lit(9)) % 2).alias("part"), F.col("i").alias("model"), F.lit(6).alias("k"), F.substring("hexamer", 1, 5).alias("hist"), F.substring("hexamer", 6, 1).alias("base"), "n")
    cloud = content.dynamic_model(counts)
    got, want = ({r["seq_id"]: r["loglik"] for r in f.collect()} for f in (content.dynamic_loglik(seqs, cloud), content._dynamic_loglik_of_counts(seqs, cloud, 0, "seq_id", "rng")))
    assert set(want) == {1, 2, 3, None} - {2} and got == pytest.approx(want)


def test_dynamic_loglik_shuffles_a_number_a_sequence(spark):
    """The counts of a sequence's words stay in its task: no exchange of the plan holds words."""
    seqs = spark.createDataFrame([(1, "ACGTACGTACGT")], "seq_id long, seq string")
    cloud = content.dynamic_model(arrays.count_words(seqs, [], 3).select(F.lit(0).alias("part"), F.col("i").alias("model"), F.lit(6).alias("k"), F.substring("hexamer", 1, 5).alias("hist"), F.substring("hexamer", 6, 1).alias("base"), "n"))
    plan = content.dynamic_loglik(seqs, cloud)._jdf.queryExecution().executedPlan().toString()
    assert "hexamer" not in plan and "Window" not in plan


def test_flanks_of_repeated_ids(spark):
    """Two rows of one id are two rows of sites, not four."""
    text = "A" * 101 + "ATG" + "GCC" * 60 + "ATG" + "GCC" * 60 + "C" * 99
    seqs = spark.createDataFrame([(1, text), (1, text)], "seq_id long, seq string")
    rows = content.flanked_sites(seqs).collect()
    assert sorted(r["pos"] for r in rows) == [102, 102, 285, 285]
    assert all(r["up"] == text[r["pos"] - 102 : r["pos"] - 6] and r["down"] == text[r["pos"] + 5 : r["pos"] + 101] for r in rows)


def test_matrix_with_a_motif_of_each_group(spark):
    rows = spark.createDataFrame([("d", "ACGTA"), ("d", "CCGTN"), ("a", "TTAGC"), ("a", "TNAGG"), ("x", "NNNNN")], "t string, site string")
    motif = F.when(F.col("t") == "a", "AG").otherwise("GT")
    both = sites.train_wam(rows, ["t"], 5, 2, motif, smooth_first=False, motif_size=2)
    for t, m in (("d", "GT"), ("a", "AG"), ("x", "GT")):
        assert same(both.where(F.col("t") == t), sites.train_wam(rows.where(F.col("t") == t), ["t"], 5, 2, m, smooth_first=False))
    assert both.where("t = 'x'").count() == 4 + 4 * 16
    counts = {(r["pos"], r["prev"], r["base"]): r["n"] for r in sites._counts(rows, ["t"], 5, True).where("t = 'a'").collect()}
    assert counts[0, "-", "T"] == 2 and counts[1, "T", "T"] == 1 and counts[4, "G", "C"] == 1 and sum(counts.values()) == 2 + 1 + 1 + 2 + 2


def test_digests_of_false_sites(spark):
    contig = "ACGTAGGTCCAGTTAGATCGGTAAG" * 30
    contigs = spark.createDataFrame([("p", contig), ("p", contig[::-1]), ("m", contig)], "contig_id string, seq string")
    exons = spark.createDataFrame([(1, "p", "+", 1, 101, 140), (1, "p", "+", 2, 201, 260), (2, "m", "-", 1, 400, 351), (2, "m", "-", 2, 300, 230)], "gene long, contig_id string, strand string, exon_no int, start int, stop int")
    listed: dict = {}
    for r in structure.false_splice_sites(exons, contigs).collect():
        assert r["site"][50:52] == {"donor": "GT", "acceptor": "AG"}[r["terminal"]] and len(r["site"]) == 102
        listed.setdefault((r["gene"], r["terminal"], r["kind"]), []).append((r["part"], r["at"], r["site"]))
    want = {k: (len(v), hashlib.md5(",".join(x[2] for x in sorted(v)).encode()).hexdigest()) for k, v in listed.items()}
    got = {(r["gene"], r["terminal"], r["kind"]): (r["n"], r["digest"]) for r in structure.false_site_digests(exons, contigs).collect()}
    assert got == want and len(want) > 6
