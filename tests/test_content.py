"""Small cases for flank scores, dynamic models, reading frames and stored models."""

import math

import pytest
from pyspark.sql import functions as F

from seqspark.operators import content, kmers, sites


def chain(spark, letters="ACGT"):
    df = spark.createDataFrame([(k, "ACGGTTACCATG" * 30 + letters * k) for k in range(6)], "seq_id long, seq string")
    return df, kmers.train_fixed_order(kmers.count_kmers(df, F.pmod(F.col("i"), F.lit(3))))


def test_fixed_order_loglik_by_hand(spark):
    df, model = chain(spark)
    table = {(r["model"], r["hist"] + r["base"]): r["p"] for r in model.collect()}
    got = {(r["seq_id"], r["model"]): r["loglik"] for r in kmers.fo_loglik(df, model).collect()}
    seq = df.where("seq_id = 3").first()["seq"]
    for m in range(3):
        want = sum(math.log(table[(i + m) % 3, seq[i : i + 6]]) for i in range(len(seq) - 5))
        assert got[3, m] == pytest.approx(want)


def test_flank_posteriors_by_hand(spark):
    _, model = chain(spark)
    table = {(r["model"], r["hist"] + r["base"]): r["p"] for r in model.collect()}
    up, down = ("ACGGTTACCATG" * 8), ("TTTTGGCA" * 12)
    got = content.flank_posteriors(spark.createDataFrame([(1, 102, up, down)], "seq_id long, pos int, up string, down string"), model).first()

    def post(s):
        like = [math.exp(sum(math.log(table[(i + m) % 3, s[i : i + 6]]) for i in range(91))) for m in range(3)]
        return sum(like) / 6 / (sum(like) / 6 + like[0] / 2)

    assert got["post_up"] == pytest.approx(post(up)) and got["post_down"] == pytest.approx(post(down))
    assert got["mcratio"] == pytest.approx(math.log(post(down) / post(up)), abs=1e-6)


def test_dynamic_loglik_fills_greedily(spark):
    hists = ["AAAAA"]
    cloud = spark.createDataFrame([(m, h, b, lo, hi) for m in range(3) for h in hists for b, lo, hi in (("A", 0.1, 0.6), ("C", 0.1, 0.5), ("G", 0.1, 0.5), ("T", 0.1, 0.3))], "model int, hist string, base string, lo_rng double, hi_rng double")
    got = content.dynamic_loglik(spark.createDataFrame([(1, "AAAAAA")], "seq_id long, seq string"), cloud).first()["loglik"]
    assert got == pytest.approx(math.log(0.6))


def test_maximal_orf(spark):
    body = "TAAGCCATGGCCGCCTGAGG"
    contig = spark.createDataFrame([("p", "CCCCCC" + body + "CCCC"), ("m", ("CCCCCC" + body + "CCCC").translate(str.maketrans("ACGT", "TGCA"))[::-1]), ("n", "GCC" * 10)], "contig_id string, seq string")
    genes = spark.createDataFrame([(1, "p", "+", 13, 18), (2, "m", "-", 18, 13), (3, "n", "+", 10, 15), (4, "p", "+", 1, 3)], "gene long, contig_id string, strand string, start int, stop int")
    got = {r["gene"]: (r["start"], r["stop"]) for r in content.maximal_orf(genes, contig).collect()}
    assert got == {1: (10, 24), 2: (21, 7), 3: (10, 15)}


def test_models_are_stored_as_tables(spark, tmp_path):
    df = spark.createDataFrame([("T", "AAAAAATGCCC"), ("F", "CCCCCATGAAA")], "hyp string, site string")
    model = sites.train_wam(df, ["hyp"])
    content.save_model(model, str(tmp_path / "wam"), ["hyp"])
    back = content.load_model(spark, str(tmp_path / "wam")).select(model.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, model.collect()))


def test_seven_models_by_hand(spark):
    """Likelihoods, posteriors and the call of both strands' models against the definition, base by base."""
    seqs = spark.createDataFrame([(k, "ACGGTTACCATG" * (3 + k) + "AC"[: k % 3] + "GT" * k) for k in range(5)], "seq_id long, seq string")
    noncoding = kmers.count_kmers(seqs.select(F.reverse("seq").alias("seq")), F.lit(kmers.BOTH_NONCODING))
    counts = kmers.count_kmers(seqs, F.pmod(F.col("i"), F.lit(3))).union(content.count_kmers_shadow(seqs)).union(noncoding)
    chain = kmers.train_fixed_order(counts)
    table = {(r["model"], r["hist"] + r["base"]): r["p"] for r in chain.collect()}
    logs = kmers.both_strand_loglik(seqs, chain)
    got = {(r["seq_id"], r["model"]): r["loglik"] for r in logs.collect()}
    calls = {r["seq_id"]: r for r in kmers.coding_call(kmers.posteriors(logs, 6), noncoding=6).collect()}
    for r in seqs.collect():
        s = r["seq"]
        want = [sum(math.log(table[m if m == 6 else (i + m) % 3 + (3 if m > 2 else 0), s[i : i + 6]]) for i in range(len(s) - 5)) for m in range(7)]
        assert [got[r["seq_id"], m] for m in range(7)] == pytest.approx(want)
        like = [math.exp(x - max(want)) * (0.5 if m == 6 else 1 / 12) for m, x in enumerate(want)]
        call = calls[r["seq_id"]]
        assert call["p_coding"] == pytest.approx(sum(like[:6]) / sum(like)) and call["coding"] == (sum(like[:6]) > like[6])
        assert like[call["best"]] == pytest.approx(max(like))


def test_posteriors_of_impossible_models(spark):
    logs = spark.createDataFrame([(1, 0, -5.0), (1, 3, float("-inf")), (2, 0, float("-inf")), (2, 3, float("-inf"))], "seq_id long, model int, loglik double")
    assert sorted(map(tuple, kmers.posteriors(logs).collect())) == [(1, 0, 1.0), (1, 3, 0.0)]


def test_shadow_counts_of_mixed_lengths(spark):
    texts = ["ACGGTTACCATGA", "TTACCATGAC", "GGCATTACGTTACG"]
    want = {}
    for t in texts:
        s = t.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        for i in range(len(s) - 5):
            cell = (3 + (i - len(s)) % 3, s[i : i + 6])
            want[cell] = want.get(cell, 0) + 1
    got = content.count_kmers_shadow(spark.createDataFrame([(t,) for t in texts], "seq string")).where("k = 6").collect()
    assert {(r["model"], r["hist"] + r["base"]): r["n"] for r in got} == want


def test_shadow_phases(spark):
    df = spark.createDataFrame([(n,) for n in (6, 7, 8)], "n int")
    assert [r[0] for r in df.select(content.shadow_phase(F.col("n"))).collect()] == [3, 5, 4]


def test_supported_structures(spark):
    structures = spark.createDataFrame([("r", [1, 2, 3], [1.0, 1.0, 1.0]), ("s", [1], [1.0])], "ref string, exons array<int>, scores array<double>")
    members = spark.createDataFrame([(1, "r", [1, 2, 3]), (1, "r", [1, 2]), (2, "s", [1])], "pgl int, ref string, exons array<int>")
    assert [(r["pgl"], r["ref"]) for r in content.supported_structures(structures, members).collect()] == [(1, "r")]


def test_small_readers_and_writers(spark, tmp_path):
    from seqspark.sources import fasta, xml

    rows = spark.createDataFrame([("+", 1.5, -0.25), ("-", -2.0, 0.0)], "label string, site_ratio double, mcratio double")
    assert sorted(map(tuple, fasta.parse_featvecs(fasta.featvec_lines(rows)).collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "o.txt").write_text(">x+ (1  9)\n  1 ACG TTA\n 61 GG\n")
    assert fasta.parse_orf_text(spark, str(tmp_path / "o.txt")).first()["seq"] == "ACGTTAGG"
    med = spark.createDataFrame([(1, "AAA", 2, 4.0), (2, "CCC", 2, 4.0)], "cluster int, site string, k int, error double")
    xml.write_medoids(med, str(tmp_path / "med"))
    assert sorted(map(tuple, xml.read_medoids(spark, str(tmp_path / "med")).select("cluster", "site", "k", "error").collect())) == sorted(map(tuple, med.collect()))


def test_joins_on_identifiers(spark):
    from seqspark.operators import structure

    iso = spark.createDataFrame([("a", 1), ("b", 2)], "locus_id string, serial int")
    found, missing = structure.locus_join(iso, spark.createDataFrame([("a", "ACG")], "locus_id string, seq string"))
    assert [r["seq"] for r in found.collect()] == ["ACG"] and [r["locus_id"] for r in missing.collect()] == ["b"]
    features = spark.createDataFrame([("c1", 1), ("c2", 2)], "contig_id string, x int")
    got = structure.remap_ids(features, spark.createDataFrame([("c1", "md5")], "contig_id string, new_id string"))
    assert sorted(map(tuple, got.select("contig_id", "x").collect())) == [("c2", 2), ("md5", 1)]
    genes = spark.createDataFrame([(1,), (2,)], "gene long")
    hits = spark.createDataFrame([(1, 10, 40, 2.0, True)], "gene long, start_codon int, stop_codon int, score double, met_seen boolean")
    twice = structure.annotate(structure.annotate(genes, hits, "LLKR"), hits, "WLLKR").orderBy("gene").collect()
    assert [[a["method"] for a in r["annots"]] for r in twice] == [["LLKR", "WLLKR"], []]


def test_quantiles_and_calls(spark):
    h = spark.createDataFrame([(10, 25), (20, 25), (30, 49), (40, 1)], "gc int, n long")
    assert {r["q"]: r["bound"] for r in kmers.gc_quantiles(h).collect()} == {1: 10, 2: 20, 3: 30, 4: 40}
    p = spark.createDataFrame([(1, 0, 0.3), (1, 4, 0.3), (1, 3, 0.4), (2, 3, 0.9), (2, 1, 0.1)], "seq_id long, model int, posterior double")
    assert {r["seq_id"]: r["coding"] for r in kmers.coding_call(p).collect()} == {1: True, 2: False}


def test_buckets_of_histories():
    counts, held = [0, 10, 11, 12, 13, 40, 100, 101], [9, 30, 30, 0, 60, 70, 80, 1]
    got = kmers.history_buckets(counts, held)
    assert sorted(i for b in got for i in b) == [1, 2, 3, 4, 5, 6, 7]  # only those that occur, each once
    assert got[0] == [1, 2, 3] and all(sum(held[i] for i in b) >= 50 for b in got[:-1]) and got[-1] == [6, 7]


def test_weights_are_the_best_of_a_grid():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(20):
        held, a, b = rng.integers(0, 9, (7, 4)), rng.dirichlet(np.ones(4), 7), rng.dirichlet(np.ones(4), 7)
        value = lambda x: (held * np.log(x * a + (1 - x) * b)).sum()  # noqa: B023, E731
        assert value(kmers.best_weight(held, a, b)) >= max(value(x) for x in np.linspace(0, 1, 201)) - 1e-9


@pytest.mark.parametrize("top_down", [True, False])
def test_deleted_interpolation(spark, top_down):
    """Rows sum to one, and order 2 agrees with the definition worked out by hand."""
    import numpy as np

    df, _ = chain(spark)
    train, held = (kmers.count_kmers(df.where(c), F.lit(0)) for c in ("seq_id < 4", "seq_id >= 4"))
    rows = kmers.train_deleted_interpolation(train, held, top_down).collect()
    table = {(r["k"], r["hist"], r["base"]): r["p"] for r in rows}
    assert len(table) == sum(4**k for k in range(1, 7)) and len(rows) == len(table)
    for k, hist in {(r["k"], r["hist"]) for r in rows}:
        assert sum(table[k, hist, b] for b in "ACGT") == pytest.approx(1)
    n, c = ({(r["k"], r["hist"], r["base"]): r["n"] for r in x.collect()} for x in (train, held))
    of = lambda x, k, h: np.array([x.get((k, h, b), 0) for b in "ACGT"])
    share = lambda k, h: of(n, k, h) / max(1, of(n, k, h).sum())
    hists = ["A", "C", "G", "T"]
    first = np.array([table[1, "", b] for b in "ACGT"])
    for bucket in kmers.history_buckets([int(of(n, 2, h).sum()) for h in hists], [int(of(c, 2, h).sum()) for h in hists]):
        own, seen = np.array([share(2, hists[i]) for i in bucket]), np.array([of(c, 2, hists[i]) for i in bucket])
        if top_down:
            w = kmers.best_weight(seen, np.array([first] * len(bucket)), own)
            want = w * first + (1 - w) * own
        else:
            want = (1 - 1e-5) * own + 1e-5 * 0.25
            for other in (np.array([share(1, "")] * len(bucket)), np.full((len(bucket), 4), 0.25)):
                w = kmers.best_weight(seen, want, other)
                want = w * want + (1 - w) * other
        for i, p in zip(bucket, want, strict=True):
            assert [table[2, hists[i], b] for b in "ACGT"] == pytest.approx(list(p))
