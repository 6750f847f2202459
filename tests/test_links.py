"""Links in Markdown: what goes, what stays, what is wrong; names with synonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragloom.functions import links

SOURCE = "https://www.comune.it/pagina"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_navigation_goes(spark):
    text = "a [1](https://x.it/?pag=2) [2](http://x.it/l?page=3&y=1) [Pagina successiva](/n) [HOME](/) [#](x) [](y) [Download](z) [s](javascript:go) [top](#a) [resta](/b) z"
    assert one(spark, links.without_navigation(F.col("t")), t=text).split() == ["a", "[resta](/b)", "z"]


def test_foreign_links_become_text(spark):
    text = "[uno](https://altro.it/x) [due](https://www.comune.it/y) [tre](https://www.inps.it/z) [quattro](relativo) [uno](https://altro.it/x)"
    got = one(spark, links.without_foreign(F.col("t"), F.col("s")), t=text, s=SOURCE)
    assert got == "uno [due](https://www.comune.it/y) [tre](https://www.inps.it/z) [quattro](relativo) uno"
    assert one(spark, links.without_foreign(F.col("t"), F.lit(None).cast("string")), t=text) == text
    assert one(spark, links.without_foreign(F.col("t"), F.lit(SOURCE)), t=None) is None


def test_malformed_links_are_mended(spark):
    text = '[[a](x)](y) [b](http:\\/\\/c) [d](u "t") [e](v w) f'
    assert one(spark, links.without_malformed(F.col("t")), t=text) == "[a] [b](http://c) d e f"


def test_generic_links_without_a_keyword_become_text(spark):
    text = "[clicca qui](u) [clicca qui](orari) [vai](u) [testo lungo](u)"
    asked = F.array(F.lit("orari"))
    assert one(spark, links.without_irrelevant(F.col("t"), asked), t=text) == "clicca qui [clicca qui](orari) vai [testo lungo](u)"
    assert one(spark, links.without_irrelevant(F.col("t"), F.array().cast("array<string>")), t=text) == text


def test_source_note_and_issues(spark):
    assert one(spark, links.with_source(F.col("t"), F.lit(SOURCE)), t="[a](b)") == "[a](b)\n\n💡 Fonte: " + SOURCE
    assert one(spark, links.with_source(F.col("t"), F.lit(SOURCE)), t="a") == "a" and one(spark, links.with_source(F.col("t"), F.lit("")), t="[a](b)") == "[a](b)"
    check = lambda t, s: one(spark, links.issues(F.col("t"), F.col("s")), t=t, s=s)
    assert check("[anagrafe](https://www.comune.it/a)", SOURCE) == []
    assert check("[lungo testo](https://altro.it/a...)", SOURCE) == ["cross_domain", "unrelated", "truncated"]
    assert check("comune [x](no address)", None) == ["no_source", "malformed"] and check("none", SOURCE) == []
    assert check("figlio [x](mailto:a@b.it) [y](ftp://h.it/z)", "ftp://h.it") == []


def test_names_take_the_longest_synonym(spark):
    name = lambda n, s: one(spark, links.expanded_name(F.col("n"), s), n=n)
    table = {"polizia": "vigili", "polizia locale": "vigili urbani, Comando", "vuoto": ""}
    assert name("Polizia Locale", table) == "Polizia Locale vigili urbani Comando vigili urbani, Comando"
    assert name("polizia", table) == "polizia vigili" and name("vuoto", table) == "vuoto" and name("altro", table) == "altro" and name("x", {}) == "x"
    assert name("comando polizia locale", {"polizia locale": "Comando"}) == "comando polizia locale Comando" and name("vigili", {"vigili": "Vigili"}) == "vigili"


def test_quality_of_links(spark):
    rows = [(1, "[anagrafe](https://a.it/x) [vai](https://b.it/y) [2](https://a.it/?page=2) [testo lungo](no address)", "https://a.it"), (1, None, None), (2, "none", "https://a.it")]
    got = {r.k: r for r in links.quality(spark.createDataFrame(rows, "k int, t string, s string"), "t", "s", "k").collect()}
    assert tuple(got[1]) == (1, 2, 4, 1, 1, 1, 1, 25.0) and tuple(got[2]) == (2, 1, 0, 0, 0, 0, 0, 0.0)
