import json

from pyspark.sql import functions as F

from inkwarden.operators import finetune, replace
from inkwarden.sources import files
from inkwarden.streaming.files import anonymize_stream, counts_by_window, document_stream


def test_labelled_corpus(spark, tmp_path):
    (tmp_path / "legal_a.jsonl").write_text('{"text": "x", "entities": [{"entity_type": "PERSON", "start": 0, "end": 1}]}\n\n{"text": "y"}\n')
    corpus = files.labelled_corpus(spark, str(tmp_path))
    assert {(r.domain, r.text, len(r.entities)) for r in corpus.collect()} == {("legal_a", "x", 1), ("legal_a", "y", 0)}
    assert {tuple(r) for r in files.by_domain(corpus, ["legal_a", "hr"]).collect()} == {("legal_a", 2, 1), ("hr", 0, 0)}


def test_jsonl_keeps_other_letters(spark, tmp_path):
    rows = spark.createDataFrame([(i, "q", "", "é") for i in range(20)], "sample_id int, instruction string, input string, output string")
    finetune.write_jsonl(finetune.split(finetune.formatted(rows), 0.1), str(tmp_path))
    lines = [x for f in (tmp_path / "train").glob("part-*") for x in f.read_text().splitlines()]
    assert len(lines) == 18 and json.loads(lines[0])["output"] == "é" and "é" in lines[0]


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    batch = spark.read.parquet(path)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    anonymize_stream(document_stream(spark, str(tmp_path / "in"), batch.schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    want = replace.anonymize(batch).select("doc_id", "anonymized_text")
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "anonymized_text")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_windows_count_all_rows_in_time(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    q = counts_by_window(document_stream(spark, str(tmp_path / "e"), events.schema)).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_seeds_of_arrays_and_lines(spark, tmp_path):
    (tmp_path / "seeds.json").write_text('[{"name": "a", "domain": "legal", "prompt_template": "p {x}"},\n {"name": "b", "domain": "hr", "example_documents": ["e"], "is_platform_default": true, "other": 1}]')
    rows = files.read_seeds(spark, str(tmp_path / "seeds.json"), lines=False).orderBy("name").collect()
    assert [(r["name"], r["example_documents"], r["custom_entity_types"], r["is_platform_default"]) for r in rows] == [("a", [], [], False), ("b", ["e"], [], True)]
