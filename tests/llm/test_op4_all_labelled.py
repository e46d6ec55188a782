from seqspark.llm import toxicity


def test_trees_are_fitted_on_all_labelled_rows(spark, monkeypatch):
    """More labelled rows than the 20,000 that were once picked: all that are not held out are fed, equal ones once."""
    docs = spark.range(0, 30_000, numPartitions=4).selectExpr("id AS doc_id", "concat('calm words ', id, IF(id % 4 = 0, ' idiot', '')) AS text")
    labels = docs.selectExpr("doc_id", "0 AS quality", "CAST(doc_id % 4 = 0 AS int) AS toxic")
    fed = []
    fit = toxicity.GBTClassifier.fit
    monkeypatch.setattr(toxicity.GBTClassifier, "fit", lambda self, rows: (fed.append(rows.count()), fit(self, rows))[1])
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    again = docs.where("doc_id < 100")
    model = toxicity.Model(docs.union(again), labels)
    want = toxicity.training_rows(docs, labels)
    assert want.count() > 23_000
    assert fed == [want.where("pmod(xxhash64(doc_id, 'calibrate'), 5) <> 0").count()]
    got = model.score(docs.where("doc_id % 997 = 0")).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got)
