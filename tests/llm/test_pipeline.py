import corpus_pipeline

from cairnfield.llm import packing

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark, docs, tmp_path):
    text = " ".join(f"alpha{i} beta gamma" for i in range(60))
    other = " ".join(f"delta{i} eps" for i in range(60))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    table = docs([text, text, "12 34", None, other, f"some words before {leak} and after", "plain clean words"], langs=["en"] * 7)
    d = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name)
        (new := stage(spark, d, SF)).write.parquet(out)
        assert new.columns == table.columns, name
        d = spark.read.parquet(out)
    assert sorted(r["doc_id"] for r in d.collect()) == [0, 4, 6]
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()
    e = packing.encoder(packing.vocabulary())
    want = {r["doc_id"]: len(e(r["text"])) + 1 for r in d.collect()}
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == want


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and sum(r["length"] for r in rows) == max(r["sequence_id"] for r in rows) * 1024 + max((r["offset"] + r["length"] for r in rows if r["sequence_id"] == max(x["sequence_id"] for x in rows)))
