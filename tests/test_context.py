"""Citations as one context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.operators import context

TABLE = "Uffici\n| Nome | Tel |\n|---|---|\n| Ada | 06 |\n| | 07 |"


def test_tables_are_told_twice(spark):
    df = spark.createDataFrame([(TABLE,), ("",), ("| a | b |\n| 1 | 2 |",), (None,)], "t string")
    got = [r[0] for r in df.select(context.table_snippet(F.col("t"))).collect()]
    assert got[0] == "**Table (alta priorità)**\n\nUffici\n\n| Nome | Tel |\n\n|---|---|\n\n| Ada | 06 |\n\n| | 07 |\n\nTabella (testo lineare di supporto):\nNome: Ada; Tel: 06\nTel: 07"
    assert got[1:] == ["", "**Table (alta priorità)**\n\n| a | b |\n| 1 | 2 |\n\nTabella (testo lineare di supporto):\na: 1; b: 2", None]


def test_contexts(spark):
    rows = [
        (1, 0, "A", "first", "http://x", None, None), (1, 1, "B", "FIRST ", "http://x", None, None), (1, 2, "C", "FIRST", "http://y", "06", None), (1, 3, "D", TABLE, None, None, None),
        (1, 4, None, None, None, None, "a@b.it"), (1, 5, "F", None, None, None, None), (2, 0, "G", "x" * 900, None, None, None),
    ]
    cited = spark.createDataFrame(rows, "q int, n int, title string, text string, url string, phone string, email string").withColumns({"address": F.lit(None).cast("string"), "schedule": F.lit("")})
    got = {r.q: r for r in context.build(cited, "q", ["n"], 800).collect()}
    parts = got[1].context.split("\n\n---\n\n")
    assert parts[0].startswith("[D]\n**Table") and parts[1] == "[A]\nfirst\n\n[Fonte](http://x)" and set(got) == {1}
    assert "[C]\nFIRST\nTelefono: 06\n\n[Fonte](http://y)" in parts and parts[-1] == "[Unknown]\nEmail: a@b.it" and got[1].parts == len(parts)
    few = {r.q: r.parts for r in context.build(cited, "q", ["n"], 230).collect()}
    assert few[1] < len(parts)
