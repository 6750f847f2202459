"""Hours and addresses near names, against all pairs of positions."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from ragloom.functions import hours
from ragloom.operators import proximity


def test_nearest_as_all_pairs():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        values, marks = rnd.integers(0, 50, rnd.integers(0, 8)), np.sort(rnd.integers(0, 50, rnd.integers(0, 8)))
        want = [min((abs(v - m) for m in marks), default=1 << 30) for v in values]
        assert proximity.nearest(values, marks).tolist() == want


def test_which_hours_can_be_meant():
    ok = lambda text: [v for v, _ in hours.schedules(text)]
    assert "dalle 9:30 alle 17:00" in ok("aperto dalle 9:30 alle 17:00")
    assert "8-17" in ok("ufficio 8-17")
    assert ok("lunedì 9:00-12:00")[0] == "9:00-12:00"
    assert ok("") == [] and ok("pagina 9:00-12:00") == []  # no word of time
    assert ok("orario 12/03/2024 9:00-12:00") == []  # a date nearby
    assert ok("orario 9:00-12:00 di marzo") == [] and ok("orario in via Roma 9:00-12:00") == []
    assert ok("orario 25:00-26:00") == [] and ok("orario 3:00-4:00") == [] and "3:00-4:00" in ok("orario notturno 3:00-4:00")
    assert ok("|Lunedì|9:00 - 12:00|chiuso|\n|---|---|\n| **mar** | 8.30 12.30 | |\n|x|9:00-10:00|") == ["Lunedì: 9:00-12:00; Chiuso", "Mar: 8.30-12.30"]


def test_addresses():
    found = lambda text: [v for v, _ in hours.addresses(text)]
    assert found("Siamo in Via Garibaldi, 12 - 40121 Bologna. Piazza  Grande") == ["Via Garibaldi, 12 - 40121", "Piazza Grande"]
    assert found("| Sede centrale | Corso Italia, 3 |\n| Presso il parco | x |") == ["Corso Italia, 3", "Sede centrale", "Presso il parco"]
    assert found("") == []


def test_offices_and_inferred_hours():
    assert hours.office_hours("UFFICIO TECNICO\n| Martedì | 9:00-12:00 |\n") == ["Martedì: 9:00-12:00", "9:00-12:00"]
    assert hours.office_hours("La Polizia Locale riceve solo su appuntamento. Altro") == ["La Polizia Locale riceve solo su appuntamento"[3:]]
    assert hours.office_hours("Vigili urbani aperti martedì e venerdì")[0].startswith("Martedì e Venerdì")
    assert hours.office_hours("ore 14:30 apertura") == ["ore 14:30"]
    assert hours.office_hours("Ufficio Tecnico 9:00-12:00", ["anagrafe"]) == hours.office_hours("ufficio 9:00-12:00")
    kind, words, at = hours.contexts("x Comando Polizia Locale")[0]
    assert (kind, words, at) == ("comando_polizia", "Comando Polizia Locale", 2)
    _, days, mail, phone = hours.from_context("Ufficio tecnico giovedì a@b.it tel: 051 1234567", "Ufficio tecnico", 0, [])
    assert days == ["giovedì"] and mail == "a@b.it" and phone.endswith("051 1234567")


def test_canonical_lines():
    assert hours.canonical(["Orario:9:00-12:00", "orario: 9:00 - 12:00", "nothing", "MARTEDÌ  9:00-12:00 x"]) == ["9: 00 - 12: 00", "martedì 9: 00 - 12: 00"]


def all_pairs(text: str, names: list[str], reach: int) -> set[tuple]:
    """Every value against every occurrence of every word."""
    low, out = text.lower(), []
    for name in names:
        words = name.split()
        marks = [m.start() for w in words if len(w) >= 3 and w not in hours.GENERIC for m in re.finditer(re.escape(w), low)]
        grams = [{x[i : i + 3] for i in range(len(x) - 2)} for x in (low, name)]
        similar = len(grams[0] & grams[1]) / len(grams[0] | grams[1]) > 0.2
        if marks and (similar or sum(w in low for w in words) >= min(2, len(words))):
            for value, at in hours.schedules(text):
                if (d := min(abs(at - m) for m in marks)) <= reach:
                    out.append((name, value, at, d))
    return {(*r, all((r[3], names.index(r[0])) <= (x[3], names.index(x[0])) for x in out if x[1] == r[1])) for r in out}


def test_hours_near_names(spark):
    rnd = random.Random(2)
    names = ["anagrafe centrale", "ufficio tributi", "polizia", "zz top"]
    words = ["anagrafe", "centrale", "tributi", "polizia", "ufficio", "orario 9:00-12:00", "orario 14:30-18:30", "altro testo qui", "parole " * 30, "top"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 25))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc long, part int, content string").withColumn("name", F.lit("clash"))
    got = proximity.near_names(df, ["doc", "part"], "content", names, "schedule").filter("value not like '%appunt%'").collect()
    for i, t in enumerate(texts):
        assert {(r.name, r.value, r.position, r.distance, r.claimed) for r in got if r.doc == i} == all_pairs(t or "", names, 350), t


def test_appointments_stand_in(spark):
    df = spark.createDataFrame([(1, "Ufficio Tributi\nTributi: riceve su appuntamento")], "doc long, content string")
    got = proximity.near_names(df, ["doc"], "content", ["Ufficio Tributi"], "schedule").collect()
    assert [(r.value, r.label, r.claimed) for r in got] == [("Tributi: riceve su appuntamento", "Ufficio Tributi", True)]
    assert proximity.near_names(df, ["doc"], "content", [], "schedule").collect() == []
    found = df.select(proximity.office_hours(F.col("content")).alias("h")).first().h
    assert found == []


def test_texts_of_one_file_go_to_all_cores(spark):
    one = spark.createDataFrame([(i, f"Torre Rossa: orario 8:{10 + i}-12:30") for i in range(40)], "k long, t string").coalesce(1)
    got = proximity.near_names(one, ["k"], "t", ["Torre Rossa", "Valle Rossa"], "schedule")
    assert got.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {r.k for r in got.filter("name = 'torre rossa' and claimed").collect()} == set(range(40))
