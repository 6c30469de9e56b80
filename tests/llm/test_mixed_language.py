"""Documents in several languages, each word labelled with confidence, have a language."""

from millrace.llm import crf_language


def test_mixed_documents_stay(spark, small):
    rows = sorted(crf_language.training_rows(spark.read.parquet(f"{small}/documents.parquet")))
    model = crf_language.train(rows)
    long = [next(t for y, t in rows if y == lang and len(t.split()) > 100).split() for lang in model.labels]
    texts = [(1, " ".join(w for t in long[:3] for w in t[:60])), (2, " ".join(w for t in long[:4] for w in t[:60])), (3, long and " ".join(long[0][:80])), (4, "1 2 3"), (5, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id for r in crf_language.with_language(d, model).collect()} == {1, 2, 3}
