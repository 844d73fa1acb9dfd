"""The pipeline's stages against brute force over their own inputs."""

import corpus_pipeline
from panelspark.llm import pii
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        seen[name] = (docs.toPandas(), out.toPandas())
        if name != names[-1]:
            assert out.columns == columns
        docs = out
    before, after = seen[names[0]]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(after["doc_id"])
    known = [i for i in before["doc_id"] if i in labels.index]
    assert sum((i in kept) == (labels[i] == 1) for i in known) > 0.9 * len(known)
    before, after = seen[names[1]]
    comp = brute_components(list(zip(before["doc_id"], before["text"])))
    assert set(after["doc_id"]) == {i for i, c in comp.items() if i == c}
    before, after = seen[names[2]]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]
    held = {i for i, t in zip(before["doc_id"], before["text"]) if any(" ".join(x.split()) in " ".join(t.split()) for x in items)}
    assert held <= set(before["doc_id"]) - set(after["doc_id"]) and len(after) >= len(before) - len(held) - 1
    before, after = seen[names[3]]
    assert len(before) == len(after) and not any(pii.emails(t) for t in after["text"])
    assert (after["n_chars"] == after["text"].str.len()).all()
    assert len(seen[names[4]][1]) == len(after)


def test_odd_rows(spark, tmp_path):
    """Null, empty, repeated and very long rows, clashing columns, and no rows at all, through all stages."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, __row long, leak string"
    text = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 400").orderBy("doc_id").first().text
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, text, "en", "a", 1, 1, "x"), (1, text, None, None, None, None, None), (None, text, "en", "a", 1, 1, "x"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, 3, "x"), (None, None, None, None, None, None, None), (4, f"{text[:300]} {item}", "en", "a", 1, 1, "x"), (5, " ".join(f"w{i % 977}" for i in range(50_000)), "en", "a", 1, 1, "x"), (6, "write to a.b@c.example now " + text[:200][::-1], "en", "a", 1, 1, "x")]
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for k, own in enumerate((rows, [])):
        docs = spark.createDataFrame(own, columns)
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[1:]:  # the first would learn from these rows only
            docs = stage(spark, docs, str(tmp_path))
            if name == "MinHash near-dedup":
                assert docs.where(docs["text"] == text).count() == len(own[:1])
            if name == "benchmark decontamination":
                assert docs.where("doc_id = 4").count() == 0 and docs.where("text is null").count() == 2 * bool(own)
            if name == "PII" and own:
                assert "[EMAIL]" in docs.where("doc_id = 6").first().text
        assert docs.count() == (0 if not own else 6)
        model_rows = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(own, columns), str(tmp_path))
        assert model_rows.columns == [x.split()[0] for x in columns.split(", ")]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
