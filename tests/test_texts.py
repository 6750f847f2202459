"""Chunking, scalar functions, crawl levels, reranking and files: small cases."""

import io
import zipfile

from pyspark.sql import functions as F

from ragloom.functions import scalars
from ragloom.operators import chunking, crawl, ranking
from ragloom.plans import matching
from ragloom.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_paragraphs_are_packed(spark):
    text = "\n\n".join(["first paragraph here", "second paragraph here", "third one"])
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  \n ")], "k long, text string")
    got = chunking.chunks(df, "text", 45, 10).orderBy("k", "chunk_index").collect()
    assert [(r.k, r.content) for r in got] == [(1, "first paragraph here\n\nsecond paragraph here"), (1, "here\n\nthird one")]


def test_sentences_and_windows():
    assert chunking.by_sentences("One two. Three four! Five?", 20, 5) == ["One two. Three four!", "four! Five?"]
    long = "x" * 100
    assert chunking.by_sentences(long, 20, 5) == chunking.windows(long, 20, 5)
    assert all(len(c) <= 1_700 for c in chunking.by_paragraphs("Some words in a sentence. " * 400, 1_500, 200))


def test_every_word_is_in_a_chunk():
    words = [f"w{i}" for i in range(3_000)]
    text = "".join(w + (".\n\n" if i % 40 == 39 else ". " if i % 7 == 6 else " ") for i, w in enumerate(words))
    held = set(" ".join(chunking.by_paragraphs(text, 300, 40)).replace(".", " ").split())
    assert held >= set(words)


def test_tables_are_flattened(spark):
    text = "intro\n| Name | Phone |\n|---|---|\n| Ann | 12 |\n| Bob | |\nend\na | b | c"
    df = spark.createDataFrame([(7, text), (8, None)], "doc_id long, text string")
    assert [(r.doc_id, r.table, r.flat) for r in chunking.flat_tables(df, "doc_id", "text").orderBy("line").collect()] == [(7, 1, "Name: Ann; Phone: 12"), (7, 1, "Name: Bob")]


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, scalars.excerpt(lit("abcdefghij"), lit(5), 4)) == "…defg…"
    assert one(spark, scalars.word_safe(lit("aaaa bbbb cccc"), 11)) == "aaaa bbbb..."
    assert one(spark, scalars.browser(lit("Mozilla Chrome/1 Safari/2"))) == "Chrome"
    assert one(spark, scalars.device(lit("an iPad Mobile"))) == "tablet"
    assert one(spark, scalars.model_family(lit("gpt-4o-mini-2024"))) == "gpt-4o-mini"
    assert one(spark, scalars.scores(lit("80, 999999999999 x"), 3)) == [80, 100, 50]
    assert one(spark, scalars.scores(lit(""), 1)) == [50]
    assert one(spark, scalars.duration(lit(125))) == "2h 5m"


def test_links_are_resolved(spark):
    base = F.lit("https://a.example/x/y?q=1")
    cases = {"/r": "https://a.example/r", "z": "https://a.example/x/z", "//b.example/c": "https://b.example/c", "mailto:me@x": None, "#top": None, "http://c.example/": "http://c.example/"}
    for href, want in cases.items():
        assert one(spark, scalars.resolve(F.lit(href), base)) == want


def test_reach_takes_the_smallest_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    seeds = spark.createDataFrame([("a",), (None,), ("a",)], "url string")
    got = {r.url: r.depth for r in crawl.reach(edges, seeds, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_lexical_score_parts(spark):
    df = spark.createDataFrame([("opening hours", "the opening hours of the office " * 4, 0, 2), ("opening hours", "nothing", 1, 2)], "q string, t string, i int, n int")
    got = [r.x for r in df.select(ranking.lexical_score(F.col("q"), F.col("t"), F.col("i"), F.col("n")).alias("x")).collect()]
    assert abs(got[0] - 1.0) < 1e-9 and abs(got[1] - (0.15 * 0.7 + 0.05 * 0.95)) < 1e-9


def test_assignment_fills_free_slots(spark):
    asked = spark.createDataFrame([(i, 1) for i in range(5)] + [(9, 2)], "id long, t long")
    able = spark.createDataFrame([(10, 1, 2), (11, 1, 0), (12, 1, 1)], "op long, t long, free long")
    got = {r.id: r.op for r in matching.assign(asked, able, "t", [F.col("id")], [F.col("op")]).collect()}
    assert got == {0: 10, 1: 10, 2: 12, 3: None, 4: None, 9: None}


def test_files_are_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "in/b.exe").write_bytes(b"x")
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="u"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:d>')
    (tmp_path / "in/d.docx").write_bytes(doc.getvalue())
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in files.read_documents(spark, f"{tmp_path}/in").collect()}
    assert got == {"a.txt": ("héllo", None), "b.exe": (None, "unsupported extension 'exe'"), "c.docx": (None, "unreadable docx: BadZipFile"), "d.docx": ("one two", None)}


def test_csv_keeps_quotes(spark, tmp_path):
    files.write_csv(spark.createDataFrame([(1, 'say "hi", you')], "k long, t string"), f"{tmp_path}/out", {"t": 8})
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out").first()
    assert back.t == 'say "hi"'


def test_partitions_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string"), path, "k")
    files.replace_partitions(spark.createDataFrame([(2, "c")], "k long, t string"), path, "k")
    assert sorted((r.k, r.t) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_sitemap_and_events(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a.example/ </loc></url><url><loc>https://b.example/</loc></url></urlset>")
    assert sorted(r.loc for r in files.read_sitemap(spark, f"{tmp_path}/s.xml").collect()) == ["https://a.example/", "https://b.example/"]
    lines = spark.createDataFrame([('{"event_id": 1, "event_type": "error"}',), ('{"event_type": "other"}',), ("broken",)], "value string")
    assert [(r.event_id, r.had_error) for r in files.parse_events(lines).collect()] == [(1, True)]


def test_user_patterns():
    assert files.user_pattern("  ") is None
    assert files.user_pattern("News") == "(?i)News"
    assert files.user_pattern("/a.b/i") == "(?i)a.b" and files.user_pattern("#x#") == "x"


def test_blocks_give_the_same_neighbours(spark, monkeypatch):
    import numpy as np

    from ragloom.operators import retrieval

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.filter("id % 10 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    key = lambda: sorted((r.query_id, r.rank, r.id, r.score) for r in retrieval.vector_top_k(q, df, 4).collect())
    whole = key()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    assert key() == whole and len(whole) == 24


def test_italian_words_end_at_other_letters(spark):
    """As the SQL's words do: ASCII letters, digits and the underscore alone belong to a word."""
    texts = ["façon délà aller", "è il la di", "éla òil ùdi", "dila ella condi", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.x for r in rows.select("i", scalars.is_italian(F.col("t")).alias("x")).orderBy("i").collect()] == [False, True, True, False, None]
