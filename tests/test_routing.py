"""Assignment in rounds against one queue, and settings over layers."""

from __future__ import annotations

import json
import random

import pytest

from pyspark.sql import functions as F

from ragloom.operators import crawl, routing, settings, text

REQUESTS = "request_id long, tenant int, required array<string>, preferred array<string>, priority string, level int, extra string"
OPERATORS = "operator_id long, tenant int, skills array<string>, load int, most int, minutes double, rating double, handled int"


def tables(spark, seed):
    rnd = random.Random(seed)
    skills = lambda: rnd.choice([None, [], rnd.sample(["it", "tax", "roads", "school"], rnd.randrange(1, 4))])
    requests = [(i, rnd.randrange(3), skills(), skills(), rnd.choice(["urgent", "high", "low"]), rnd.randrange(3), "x") for i in range(40)]
    operators = [(i, rnd.randrange(3), skills(), rnd.randrange(3), rnd.randrange(0, 6), rnd.choice([None, 1.0, 6.0, 20.0]), rnd.choice([None, 2.0, 4.2, 5.0]), rnd.choice([10, 30, 90])) for i in range(12)]
    return requests, spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(operators, OPERATORS), {o[0]: max(0, o[4] - o[3]) for o in operators}


@pytest.mark.parametrize("seed", range(3))
def test_rounds_as_one_queue(spark, seed):
    requests, r, o, room = tables(spark, seed)
    kinds = r.select("request_id", routing._profile().alias("profile")).collect()
    scores = {}
    for x in routing.suited(r, o).collect():
        scores.setdefault(x.profile, []).append((-x.score, x.operator_id))
    best = {x.request_id: (x.operator_id, x.score) for x in routing.best_operator(r, o).collect()}
    assert best == {k.request_id: (min(scores[k.profile])[1], -min(scores[k.profile])[0]) for k in kinds if k.profile in scores}
    profile, want = {k.request_id: k.profile for k in kinds}, {}
    for q in sorted(requests, key=lambda q: (q[5], q[0])):
        for points, operator in sorted(scores.get(profile[q[0]], [])):
            if -points >= 30 and room[operator] > 0:
                room[operator] -= 1
                want[q[0]] = operator
                break
    got = routing.assign(r, o, ["level"]).collect()
    assert {x.request_id: x.operator_id for x in got} == want and len(got) == len(want)


def test_nobody_asks_or_answers(spark):
    _, r, o, _ = tables(spark, 9)
    assert routing.assign(r.limit(0), o, ["level"]).collect() == [] and routing.assign(r, o.limit(0), ["level"]).collect() == []


def test_layers():
    base = {"a": {"b": 1, "c": [1, 2, 3]}, "d": 5, "e": {"f": 1}}
    assert settings.merged(base, {"a": {"b": 2, "c": [9]}, "d": {"x": 1}, "e": 7, "g": None}) == {"a": {"b": 2, "c": [9, 2, 3]}, "d": {"x": 1}, "e": 7, "g": None}
    assert settings.merged(base, {}) == base and base["a"]["b"] == 1
    assert settings.at_paths({"a": {"b": 1}}, {"a.c": 2, "x.y.z": 3}) == {"a": {"b": 1, "c": 2}, "x": {"y": {"z": 3}}}


def test_settings_of_tenants(spark):
    tenants = spark.createDataFrame([(1, None, None), (2, "p", '{"k": {"b": 9}}'), (3, "none", "broken{"), (4, "p", "[1]"), (5, "p", '{"k": 3}')], "tenant int, profile string, settings string")
    profiles = spark.createDataFrame([("p", '{"k.a": 5, "n.m": true}')], "profile string, overrides string")
    got = {r.tenant: json.loads(r.resolved) for r in settings.resolved(tenants, profiles, {"k": {"a": 1, "b": 2}}, tenant_defaults={"t": 0}).collect()}
    base = {"k": {"a": 1, "b": 2}, "t": 0}
    assert got == {1: base, 2: {"k": {"a": 5, "b": 9}, "t": 0, "n": {"m": True}}, 3: base, 4: {"k": {"a": 5, "b": 2}, "t": 0, "n": {"m": True}}, 5: {"k": 3, "t": 0, "n": {"m": True}}}


def test_known_pages_come_again_when_they_are_old(spark):
    rows = [("a", "2024-01-30"), ("b", "2024-01-01"), ("c", "2024-01-01"), ("c", "2024-01-29"), ("d", None), (None, "2024-01-30")]
    known = spark.createDataFrame(rows, "url string, scraped_at string").withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    urls = spark.createDataFrame([(u,) for u in ("a", "b", "c", "d", "e", "e", None)], "url string")
    now = F.lit("2024-01-31").cast("timestamp")
    fetch = lambda days: sorted((r.url or "") for r in crawl.to_fetch(urls, known, now, days).collect())
    assert fetch(7) == ["", "b", "d", "e", "e"] and fetch(None) == ["", "e", "e"] and fetch(100) == ["", "d", "e", "e"]


def test_required_terms_and_keys(spark):
    df = spark.createDataFrame([("Anagrafe", "http://A"), ("ufficio", "http://a "), (None, None)], "t string, u string")
    holds = lambda terms: [r[0] for r in df.select(text.holds_required(F.col("t"), terms, ("ufficio",))).collect()]
    assert holds(["ANAGRAFE ", "ufficio"]) == [True, False, False] and holds(["ufficio", "an"]) == [False] * 3 and holds([]) == [True] * 3
    keys = [r[0] for r in df.select(text.dedup_key(F.lit(" X"), F.col("u"))).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_assignment_in_blocks_of_the_queue(spark):
    """Blocks far smaller than a tenant's queue give what one queue gives, in as many rounds as there are blocks."""
    o = spark.createDataFrame([(1, i, ["a", "b"][i % 2 :], 0, 1 + i % 3, 5.0, 4.0, 10) for i in range(30)], "tenant int, operator_id long, skills array<string>, load int, most int, minutes double, rating double, handled int")
    r = spark.createDataFrame([(1, i, ["a"] if i % 3 else ["b"], None, "normal", f"p{i % 4}") for i in range(200)], "tenant int, request_id long, required array<string>, preferred array<string>, priority string, level string")
    whole = {tuple(x) for x in routing.assign(r, o, ["level"]).collect()}
    assert whole == {tuple(x) for x in routing.assign(r, o, ["level"], block=7).collect()}
    room, want = {i: 1 + i % 3 for i in range(30)}, {}
    fit = {(x.profile): [] for x in routing.suited(r, o).select("profile").distinct().collect()}
    for x in routing.suited(r, o).filter("score >= 30").collect():
        fit[x.profile].append((-x.score, x.operator_id))
    kind = {x.request_id: x.profile for x in r.select("request_id", routing._profile().alias("profile")).collect()}
    for i in sorted(range(200), key=lambda i: (f"p{i % 4}", i)):
        free = [k for _, k in sorted(fit[kind[i]]) if room[k]]
        if free:
            want[i] = free[0]
            room[free[0]] -= 1
    assert {x[0]: x[1] for x in whole} == want and len(want) == 60
