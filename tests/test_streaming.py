from lodewright.streaming import dedup


def test_stream_keeps_one_row_per_text(spark, tiny, tmp_path):
    batch = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source", "ingested_at").orderBy("doc_id").limit(100).cache()
    (tmp_path / "in").mkdir()
    batch.write.parquet(str(tmp_path / "in" / "one"))
    batch.write.parquet(str(tmp_path / "in" / "two"))
    stream = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    seen = []
    dedup.start(stream, lambda df, _: seen.extend(r.doc_id for r in df.select("doc_id").collect()), str(tmp_path / "ck")).awaitTermination(120)
    texts = {r.text for r in batch.collect()}
    assert len(seen) == len(texts)


def test_arrivals_in_batch_form(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert sum(r.n_docs for r in dedup.arrivals(docs).collect()) == docs.where("ingested_at is not null").count()
