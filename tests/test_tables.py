"""Tables and directories in small texts."""

from pyspark.sql import functions as F

from ragloom.operators import tables

TABLE = "Contatti\n\nUfficio tributi\n| Nome | Telefono | |\n|---|---|---|\n| Anna | 06 111 | x |\n| Bruno | | |\n\nFine"
LARGE = "Orari\n| Giorno | Ora |\n|---|---|\n" + "\n".join(f"| g{i} | {i}:00 |" for i in range(9))
DIRECTORY = "Ufficio Anagrafe\n06 1234567\nVia Roma 1\nUfficio Tributi\nTel: 06 7654321 / 06 7654322\nPiazza Dante 3"


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tables_have_context(spark):
    got = tables.find_tables(frame(spark, TABLE, LARGE, None, "", "| a | b |", "x\n| a | b |\ny"), "doc_id", "text").collect()
    assert [(r.doc_id, r.table, r.start_line, r.rows, r.cols, r.context_before, r.context_after) for r in got] == [(0, 0, 3, 4, 3, "Ufficio tributi", "Fine"), (1, 0, 1, 11, 2, "Orari", "")]


def test_small_tables_stay_whole_and_large_ones_are_cut(spark):
    got = tables.chunk_tables(frame(spark, TABLE, LARGE), "doc_id", "text").orderBy("doc_id", "part").collect()
    assert [r.kind for r in got] == ["table"] + ["table_row"] * 9
    assert got[0].content.startswith("Ufficio tributi\n\n| Nome") and got[0].content.endswith("Fine")
    assert got[1].content == "Orari\n\nGiorno: g0\nOra: 0:00"


def test_directories_need_two_entries(spark):
    df = frame(spark, DIRECTORY, "\n".join(DIRECTORY.split("\n")[:3]), None)
    got = {r.doc_id: r.e for r in df.select("doc_id", tables.directory_entries(F.col("text")).alias("e")).collect()}
    assert [(e.name, e.phones, e.address) for e in got[0]] == [("Ufficio Anagrafe", "06 1234567", "Via Roma 1"), ("Ufficio Tributi", "06 7654321 / 06 7654322", "Piazza Dante 3")]
    assert got[1] == [] == got[2]


def test_chunks_by_source(spark):
    df = frame(spark, TABLE, "# www.example.org\n**URL:** x\nText of a page", DIRECTORY).withColumn("source", F.when(F.col("doc_id") == 1, "web").otherwise("upload"))
    got = sorted((r.doc_id, r.kind) for r in tables.chunk_by_source(df, "doc_id", "text", F.col("source") == "web", 500, 50).collect())
    assert got == [(0, "standard"), (0, "table"), (1, "standard"), (2, "directory_entry"), (2, "directory_entry"), (2, "standard")]
