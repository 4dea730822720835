"""The driver's contract, and the plan of the flagship query."""

import __spark_entry__ as entry
from quillspark.plans import audit


def test_every_query_has_a_check_or_a_reason(spark):
    without = {"op1_token_ids", "op2_near_dup", "op5_embedding", "op6_toxicity", "op7_bpe", "op8_suffixes", "op12_pii", "op13_conversations", "pipeline"}
    assert set(entry.queries()) - set(entry.oracle_sql()) <= without
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.total == r.with_citations + r.needing + r.ok for r in rows)


def test_audit_reads_two_columns_and_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("lang", "text")
    plan = audit.counts(audit.analyses(docs), "lang")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "Python" not in plan


def test_cited_sentences_can_be_audited(spark):
    docs = spark.createDataFrame([(1, "We propose a method that outperforms BERT [Doe, 2019].")], "doc_id int, text string")
    assert [r.needs_citation for r in audit.analyses(docs).collect()] == [False]
    assert [r.needs_citation for r in audit.analyses(docs, audit_cited=True).collect()] == [True]


def test_append_stream_adds_each_entry_once(spark, tmp_path):
    from quillspark.streaming.append import append_new

    rows = spark.createDataFrame([("a", "10.1/a"), ("b", "10.1/b")], "key string, doi string")
    for n in (1, 2):
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        append_new(stream, f"{tmp_path}/lib", f"{tmp_path}/check").awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/lib").collect()) == ["a", "b"]
