"""Streams over a table that is a folder of part files, as larger tables are."""

from mullion import registry


def test_every_feed_reads_a_table_of_several_files(spark, tmp_path):
    docs = [(i, f"text {i % 5}", "a" if i < 10 else "b") for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["T6"](spark, str(tmp_path)).collect()
    want = {}
    for i, text, source in docs:
        want[source, text] = max(want.get((source, text), 0), i % 4)
    assert len(got) == len(want) == 10
    assert sorted(r.reader_version for r in got) == sorted(want.values())


def test_a_table_without_rows_gives_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert registry.queries()["T6"](spark, str(tmp_path)).collect() == []


def test_a_single_file_is_read_as_before(spark, sf):
    assert registry.queries()["T6"](spark, sf).count() > 0
