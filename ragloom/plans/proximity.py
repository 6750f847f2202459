"""Hours and addresses near names, in contact cards that are put together from given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import proximity
from ..session import load
from .registry import ORACLE, QUERIES

# one card for each customer: an office of its nation, hours, and an address of another customer's office
_DAY = "(CASE c_custkey % 3 WHEN 0 THEN 'ricevimento' WHEN 1 THEN 'pomeriggio' ELSE 'mattina' END)"
_HOURS = ("(7 + c_custkey % 4) || ':30'", "(13 + c_custkey % 6) || ':45'")
_CARD = f"""'Sede ' || n_name || ': ' || {_DAY} || ' con orario ' || {_HOURS[0]} || '-' || {_HOURS[1]} || '.' || repeat(' Testo', (c_custkey % 80)::INT) || ' Altra sede di ' || o_name
    || repeat(' e altro testo', 6) || ' in via ' || n_name || ', ' || (c_custkey % 90) || '.'"""
#: Offices are called by two words, from the keys of nations.
_NAME = "split_part('Torre,Porta,Valle,Isola,Costa', ',', cast(floor(n_nationkey / 5.0) AS int) % 5 + 1) || ' ' || split_part('Rossa,Verde,Blu,Nera,Gialla', ',', n_nationkey % 5 + 1)"
_SQL = f"SELECT c_custkey, {{card}} AS card FROM customer JOIN (SELECT n_nationkey, {_NAME} AS n_name FROM nation) ON c_nationkey = n_nationkey JOIN (SELECT n_nationkey AS o_key, {_NAME} AS o_name FROM nation) ON o_key = (n_nationkey * 7 + 3) % 25"


def cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation").select("n_nationkey", F.expr(_NAME).alias("n_name"))
    other = nation.select(F.col("n_nationkey").alias("o_key"), F.col("n_name").alias("o_name"))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(other, F.expr("o_key = (n_nationkey * 7 + 3) % 25"))
    card = F.expr(_CARD.replace("::INT", "")).alias("card")
    return rows.select("c_custkey", card), sorted(r.n_name for r in nation.select("n_name").distinct().collect())


def _near(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, names = cards(spark, sf_dir)
        return proximity.near_names(found, ["c_custkey"], "card", names, kind).select("c_custkey", "name", "value", "position", "distance", F.round("score", 6).alias("score"), "claimed")

    return query


# every occurrence of every word against every value, all pairs
_ALL = f"""WITH cards AS ({_SQL.format(card=_CARD)}), low AS (SELECT c_custkey, card, lower(card) AS low FROM cards),
names AS (SELECT lower(n_name) AS name, string_split(lower(n_name), ' ') AS words FROM (SELECT DISTINCT {_NAME} AS n_name FROM nation)),
hit AS (SELECT c_custkey, card, low, name, words, list_distinct(list_transform(range(1, greatest(2, length(low) - 1)), lambda i: substr(low, i, 3))) AS g, list_distinct(list_transform(range(1, greatest(2, length(name) - 1)), lambda i: substr(name, i, 3))) AS h
    FROM low, names),
here AS (SELECT *, len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h)))::DOUBLE AS sim FROM hit
    WHERE len(list_filter(words, lambda w: contains(low, w) AND length(w) >= 3)) > 0 AND (len(list_filter(words, lambda w: contains(low, w))) >= least(2, len(words)) OR len(list_intersect(g, h)) > 0.2 * len(list_distinct(list_concat(g, h))))),
word AS (SELECT *, unnest(words) AS w FROM here),
marks AS (SELECT c_custkey, name, unnest(list_transform(range(1, len(string_split(low, w))), lambda i: list_sum(list_transform(string_split(low, w)[1:i], lambda p: length(p))) + (i - 1) * length(w))) AS mark FROM word WHERE length(w) >= 3)"""
_BEST = "SELECT c_custkey, name, value, position::INT AS position, distance::INT AS distance, round(score, 6) AS score, row_number() OVER (PARTITION BY c_custkey, value ORDER BY distance, name) = 1 AS claimed FROM x"
QUERIES["E4_schedules_near_names"] = _near("schedule")
ORACLE["E4_schedules_near_names"] = f"""{_ALL},
vals AS (SELECT c_custkey, card, unnest([{_HOURS[0]} || '-' || {_HOURS[1]}, 'orario ' || {_HOURS[0]} || '-' || {_HOURS[1]}, 'orario ' || {_HOURS[0]}]) AS value FROM cards),
pairs AS (SELECT v.c_custkey, m.name, value, instr(card, value) - 1 AS position, min(abs(instr(card, value) - 1 - mark)) AS distance FROM vals v JOIN marks m ON v.c_custkey = m.c_custkey GROUP BY ALL),
x AS (SELECT p.*, sim + greatest(0, 1 - distance / 350.0::DOUBLE) AS score FROM pairs p JOIN here h ON p.c_custkey = h.c_custkey AND p.name = h.name WHERE distance <= 350) {_BEST}"""
QUERIES["E3_addresses_near_names"] = _near("address")
ORACLE["E3_addresses_near_names"] = f"""{_ALL},
vals AS (SELECT c_custkey, card, regexp_extract(card, 'via [^0-9]+ [0-9]+') AS value FROM cards),
place AS (SELECT c_custkey, name, sim, low, words, CASE WHEN contains(low, name) THEN instr(low, name) - 1 WHEN len(list_filter(words, lambda w: contains(low, w))) >= 2 THEN
    list_sum(list_transform(list_filter(words, lambda w: contains(low, w))[1:2], lambda w: instr(low, w) - 1)) // 2 ELSE instr(low, list_filter(words, lambda w: contains(low, w))[1]) - 1 END AS name_at FROM here),
x AS (SELECT p.c_custkey, name, value, instr(card, value) - 1 AS position, abs(instr(card, value) - 1 - name_at) AS distance, sim + greatest(0, 1 - abs(instr(card, value) - 1 - name_at) / 450.0::DOUBLE) AS score FROM place p JOIN vals v ON p.c_custkey = v.c_custkey
    WHERE abs(instr(card, value) - 1 - name_at) <= 450 AND len(list_filter(words, lambda w: length(w) >= 3 AND contains(substr(low, greatest(1, instr(card, value) - 200)::BIGINT, 400), w))) > 0) {_BEST}"""
