"""What training takes in the driver is given back: the stages after it run in the same process."""

from vektra.llm import toxicity


def test_training_gives_memory_back(spark, monkeypatch):
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a, **o: seen.append("fit") or fit(*a, **o))
    monkeypatch.setattr(toxicity, "give_back", lambda: seen.append("given back"))
    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else "vile words there") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) as toxic")
    model = toxicity.train(docs, labels, steps=3)
    assert seen == ["fit", "given back"] and toxicity.Scorer(model).score(["vile words"]).shape == (1,)
