import duckdb
import pyarrow as pa
import pytest

from seqspark.llm import mixing
from seqspark.llm.queries import ORACLE


def rows_of():
    rows = []
    for s, (n, size) in {"a": (200, 50), "b": (50, 20), "c": (5, 10), None: (100, 5), "é": (30, 0)}.items():
        rows += [(len(rows) + k, s, " \t".join(["w"] * (size + k % 3 if size else 0)), 1) for k in range(n)]
    return [*rows, (5000, "c", None, 1), (5001, "c", "long " * 200, 1), (3, "a", "same id", 1), (None, "b", "no id", 1)]


def brute_targets(sizes):
    """Shares by weight; what caps leave is shared again until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share | {s: 3 * sizes[s] for s in capped}
        capped |= over


def test_targets_and_taken(spark):
    df = spark.createDataFrame(rows_of(), "doc_id long, source string, text string, rank int")
    got = mixing.report(df).collect()
    assert len(got) == len(rows_of())
    sizes, taken, target = {}, {}, {}
    for i, s, t, _ in rows_of():
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    by_source = {(i, len((t or "").split())): s for i, s, t, _ in rows_of()}
    for r in got:
        s = by_source[r["doc_id"], r["size"]]
        taken[s], target[s] = taken.get(s, 0) + r["taken"], r["target"]
        assert r["source_size"] == sizes[s] and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    assert target == pytest.approx(brute_targets(sizes))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (200 if s == "c" else 60)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.report(df.repartition(7)).collect()), key=str)


def test_mix_repeats_rows_with_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(), "doc_id long, source string, text string, rank int").withColumnRenamed("rank", "u")
    out = mixing.mix(df)
    assert out.columns == df.columns
    want = sum(r["taken"] for r in mixing.report(df).collect())
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == want


def test_empty_and_wordless_tables(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.report(spark.createDataFrame([], schema)).collect() == []
    got = mixing.report(spark.createDataFrame([(1, "a", ""), (2, "b", None)], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_documents_have_unequal_probabilities_and_agree_with_sql(spark):
    rows = [(k, "ab"[k % 2], " ".join(["w"] * (1 + k * k % 97)), 1) for k in range(900)] + rows_of()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rank int")
    by_digits = {}
    for r in mixing.shares(mixing.sizes_of(df)).where("source = 'a'").collect():
        by_digits[r["digits"]] = r["copies"] + r["p"]
    assert len(set(by_digits.values())) > 3 and all(by_digits[a] <= by_digits[b] for a in by_digits for b in by_digits if a < b)
    documents = pa.table({"doc_id": [r[0] for r in rows], "source": [r[1] for r in rows], "text": [r[2] for r in rows]})
    want = duckdb.sql(ORACLE["op8_mixing"]).fetchall() if documents.num_rows else None
    got = mixing.report(df).collect()
    close = lambda x: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x), key=str)
    assert close(got) == close(want)


@pytest.mark.parametrize("text", ["one text for all rows", None])
def test_rows_without_ids_come_near_the_target(spark, text):
    rows = [(None, "a", text or f"own text {k} " * (k % 9 + 1)) for k in range(500)] + [(k, "b", "w " * 30) for k in range(100)] + [(7, "c", "w w w w w")] * 300
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = [(r["source_size"], r["target"], r["taken"], r["size"]) for r in mixing.report(df).collect()]
    for size, target in {x[:2] for x in got}:
        own = [x for x in got if x[:2] == (size, target)]
        assert abs(sum(x[2] for x in own) - target) <= max(x[3] for x in own)
    assert mixing.mix(df).count() == sum(1 for x in got for _ in range(x[2] // x[3]))
