"""Sinks: what is written and what stays."""

import pytest

from ragloom.operators import contacts
from ragloom.sources import files


def test_vectors_are_replaced_by_document(spark, tmp_path):
    path = f"{tmp_path}/v"
    frame = lambda *rows: spark.createDataFrame(rows, "tenant_id int, doc_id long, chunk_index int, v array<double>")
    files.upsert_vectors(frame((1, 10, 0, [1.0]), (1, 10, 1, [2.0]), (1, 11, 0, [3.0]), (2, 10, 0, [4.0])), path)
    files.upsert_vectors(frame((1, 10, 0, [9.0])), path)
    got = sorted((r.tenant_id, r.id, r.v[0]) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1_000_000, 9.0), (1, 1_100_000, 3.0), (2, 1_000_000, 4.0)]


def test_an_unreadable_table_is_no_absent_one(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part.parquet").write_text("broken")
    rows = spark.createDataFrame([(1, 10, 0, [9.0])], "tenant_id int, doc_id long, chunk_index int, v array<double>")
    with pytest.raises(Exception, match="(?i)parquet"):
        files.upsert_vectors(rows, f"{tmp_path}/v")
    assert (tmp_path / "v" / "part.parquet").read_text() == "broken"


def test_submissions_have_a_column_for_each_field(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"name": "A \\"x\\"", "other": "z"}'), (2, None)], "id int, data string")
    files.write_submissions_csv(rows, f"{tmp_path}/s", ["name", "mail"])
    got = spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{tmp_path}/s").orderBy("id").collect()
    assert [(r.id, r.name or "", r.mail or "") for r in got] == [("1", 'A "x"', ""), ("2", "", "")]


def test_feedback_is_cut(spark, tmp_path):
    files.write_feedback_csv(spark.createDataFrame([(1, "a" * 300)], "id int, answer string"), f"{tmp_path}/f")
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/f").first().answer) == 200


def test_markdown_of_documents(spark, tmp_path):
    files.write_markdown(spark.createDataFrame([(7, 1, "b"), (7, 0, "a"), (8, 0, None)], "doc_id int, chunk_index int, content string"), f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m/doc_id=7").collect()] == ["a", "", "b"]


def test_phones_that_are_dates_are_left_out(spark):
    df = spark.createDataFrame([(1, "Mario Rossi, nato il 12/03/1970, P.IVA 01234567890, tel 06 7654321")], "id int, content string")
    assert [r.value for r in contacts.near_name(df, ["id"], "content", "mario rossi", "phone").collect()] == ["067654321"]
