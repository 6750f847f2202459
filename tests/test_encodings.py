"""Charsets, double decoding and confused characters."""

from __future__ import annotations

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.functions import encodings

BYTES = [bytes([b]) for b in range(256)]
AS_1252 = {b: (b.decode("cp1252") if b not in (b"\x81", b"\x8d", b"\x8f", b"\x90", b"\x9d") else b.decode("latin-1")) for b in BYTES}


def misread(text: str) -> str:
    return "".join(AS_1252[bytes([b])] for b in text.encode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aè’ñ€日😀 .Z"), max_size=30), st.integers(1, 3))
def test_misreadings_come_back(text, times):
    assume(encodings.repair(text) == text)  # itself no misreading of something else
    bad = text
    for _ in range(times):
        bad = misread(bad)
    assert encodings.repair(bad) == text
    assert encodings.repair(text.encode().decode("latin-1")) == text


@pytest.mark.parametrize("text", ["château", "È già più", "Â", "â ê î", "naïve — “x”", "Ã", "ÃÃ", "€uro", "日本", ""])
def test_good_text_stays(text):
    assert encodings.repair(text) == text


def test_mixed_text_and_null():
    assert encodings.repair("è giÃ\xa0 lâ€™anno È") == "è già l’anno È"
    assert encodings.repair(None) is None


def test_charset_precedence(spark):
    meta = b'<html><meta charset="windows-1252">\xe8</html>'
    cases = [
        ("è".encode(), "text/html; charset=UTF-8", "utf-8", "è"),
        (b"\xe8", "text/html; charset='latin1'", "iso-8859-1", "è"),
        (b"\x93x\x94", "text/html; charset=ISO-8859-1", "windows-1252", '"x"'),
        (meta, None, "windows-1252", '<html><meta charset="windows-1252">è</html>'),
        (meta, "text/html; charset=iso-8859-1", "iso-8859-1", '<html><meta charset="windows-1252">è</html>'),
        (meta, "text/html; charset=klingon", "windows-1252", '<html><meta charset="windows-1252">è</html>'),
        ("già".encode(), "", "utf-8", "già"),
        (b"gi\xe0", None, "iso-8859-1", "già"),
        (b"a\x92b", None, "windows-1252", "a'b"),
        ("è�".encode(), None, "utf-8", "è�"),
        ("giÃ\xa0".encode(), None, "utf-8", "già"),
        (b"", None, "utf-8", ""),
        (None, "text/html; charset=utf-8", None, None),
        (b"ok \xff", "text/html; charset=utf-8", "utf-8", "ok �"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, content binary, kind string")
    c, k = F.col("content"), F.col("kind")
    got = df.select("i", encodings.charset(c, k).alias("name"), encodings.fetched_text(c, k).alias("text")).orderBy("i").collect()
    assert [(r.name, r.text) for r in got] == [x[2:] for x in cases]


def test_confused_characters(spark):
    df = spark.createDataFrame([("pla! plas!ca pia% riﬁu! bo%glie u!lizzare sacche$o x�y",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(encodings.unconfused(F.col("text"))).collect()] == ["plat plastica piatti rifiuti bottiglie utilizzare sacchetto xy", None, ""]
