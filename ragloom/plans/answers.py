"""Citation scores, gating, intents, completeness, boosts and form triggers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import answers, cascade
from .registry import PARTS, TURNS, add, add_derived, spread


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _count(text: str, words) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


_FILES = [f".{x}" for x in answers.GOOD_FILES]
_SCORED = f"""
p AS (SELECT *, lower(coalesce(source, '')) AS ls, lower(coalesce(url, '')) AS lu, lower(content) AS lc, length(content) AS n,
    lower(concat_ws(' ', coalesce(title, ''), coalesce(source, ''), content, coalesce(url, ''))) AS every, list_filter(regexp_split_to_array(lower(coalesce(query, '')), '\\s+'), lambda w: length(w) > 3) AS qw
    FROM cites WHERE trim(coalesce(content, '')) <> ''),
q AS (SELECT *, least(1.0, 0.5 + CASE WHEN {_any('ls', _FILES)} OR {_any('lu', _FILES)} THEN 0.3 ELSE 0 END + CASE WHEN {_any('lu', answers.OFFICIAL_HOSTS)} THEN 0.2 ELSE 0 END)::DOUBLE AS s1,
    least(1.0, CASE WHEN n < 50 THEN 0.2 WHEN n < 200 THEN 0.5 WHEN n <= 1000 THEN 1.0 WHEN n <= 2000 THEN 0.8 ELSE 0.6 END
        + CASE WHEN contains(content, '|') OR contains(content, 'Nominativo') OR regexp_matches(content, '(?m)^\\s*[-*•]\\s') THEN 0.15 ELSE 0 END)::DOUBLE AS s2,
    least(1.0, 0.3 + least(0.45, {_count('every', answers.AUTHORITY_WORDS)} * 0.15) + CASE WHEN has_metadata THEN 0.1 ELSE 0 END)::DOUBLE AS s3,
    least(1.0, CASE WHEN len(qw) > 0 THEN len(list_filter(qw, lambda w: contains(lc, w))) / len(qw)::DOUBLE ELSE 0.5 END * 0.6 + CASE intent
        WHEN 'phone' THEN CASE WHEN coalesce(phone, '') <> '' THEN 0.4 ELSE 0 END WHEN 'email' THEN CASE WHEN coalesce(email, '') <> '' THEN 0.4 ELSE 0 END
        WHEN 'address' THEN CASE WHEN {_any('lc', ('via ', 'piazza ', 'indirizzo'))} THEN 0.3 ELSE 0 END
        WHEN 'hours' THEN CASE WHEN contains(lc, ':') AND {_any('lc', ('orari', 'apertura'))} THEN 0.3 ELSE 0 END
        WHEN 'schedule' THEN CASE WHEN contains(lc, ':') AND {_any('lc', ('orari', 'apertura'))} THEN 0.3 ELSE 0 END ELSE 0 END)::DOUBLE AS s4 FROM p),
c AS (SELECT *, (s1 * 0.2::DOUBLE + s2 * 0.3::DOUBLE + s3 * 0.25::DOUBLE + s4 * 0.25::DOUBLE) * coalesce(score, 1.0)::DOUBLE AS whole FROM q)
SELECT id, round(s1, 4) AS source_score, round(s2, 4) AS quality_score, round(s3, 4) AS authority_score, round(s4, 4) AS intent_match_score, round(whole, 4) AS composite FROM c WHERE whole >= 0.3"""
_PARTS = ["id", "source_score", "quality_score", "authority_score", "intent_match_score", "composite"]

_CITES = """SELECT * FROM (VALUES
    (1, 'Gli orari di apertura dello sportello sono: lunedì 9:00-12:00, mercoledì 9:00-12:00 e venerdì 15:00-17:00, salvo i giorni festivi.', 'upload', 'https://comune.example.it/orari.pdf', 'Orari ufficio', TRUE, NULL, NULL, 'orari apertura sportello', 'hours', 0.9),
    (2, 'Telefono 06 1234567', 'web', 'https://www.example.com/contatti', 'Contatti', FALSE, '06 1234567', '', 'telefono ufficio tributi', 'phone', 1.0),
    (3, 'Scrivere a info@example.com', 'web', 'https://www.example.com', NULL, FALSE, NULL, 'info@example.com', 'email', 'email', NULL),
    (4, '| Nominativo | Ruolo |', 'delibera.docx', NULL, 'Delibera della giunta', TRUE, NULL, NULL, 'chi sono gli assessori', '', 0.8),
    (5, '   ', 'web', NULL, NULL, FALSE, NULL, NULL, 'qualcosa', '', 1.0),
    (6, 'Piazza Roma 1, indirizzo della sede', 'web', 'https://regione.example.it', NULL, FALSE, NULL, NULL, 'dove si trova la sede', 'address', 0.7),
    (7, 'Testo breve', 'web', NULL, NULL, FALSE, NULL, NULL, 'tutt altro argomento', 'phone', 0.2))
    AS t(id, content, source, url, title, has_metadata, phone, email, query, intent, score)"""
add_derived("QS2_citation_parts", {"cites": spread(_CITES, 7, "content source url title has_metadata phone email query intent score", "documents", "doc_id", "content")}, lambda c: answers.score_citations(c).select(*_PARTS), "," + _SCORED)
_AS_CITATIONS = "SELECT doc_id AS id, text AS content, source, NULL AS url, NULL AS title, FALSE AS has_metadata, NULL AS phone, NULL AS email, 'cuando apre the office' AS query, 'address' AS intent, 1.0 AS score FROM documents"
add("QS1_citation_score", "documents", lambda d: answers.score_citations(d.selectExpr(
    "doc_id as id", "text as content", "source", "cast(null as string) as url", "cast(null as string) as title", "false as has_metadata", "cast(null as string) as phone", "cast(null as string) as email", "'cuando apre the office' as query", "'address' as intent", "1.0D as score",
)).select(*_PARTS), f"WITH cites AS ({_AS_CITATIONS}), {_SCORED}")

add_derived("QS6_gating", {"a": "SELECT event_id AS id, CAST(event_id % 4 AS INT) AS citations, coalesce(value, 0) / 100 AS confidence FROM events"},
    lambda a: a.select("id", answers.falls_back(F.col("citations"), F.col("confidence")).alias("forced"), answers.falls_back(F.col("citations"), F.col("confidence"), least_citations=2, force=False).alias("strict")),
    "SELECT id, (citations < 1 OR confidence < 0.05) AND NOT citations > 0 AS forced, citations < 2 OR confidence < 0.05 AS strict FROM a")

_FORMS = (answers.Form("quote", words=("quote", "ther"), after_messages=9), answers.Form("support", questions=("where that into", "they will come back")), answers.Form("survey", after_messages=3))
add("QS8_form_triggers", "conversations", lambda c: c.filter("role = 'user'").select("conv_id", "turn", answers.form_trigger(F.coalesce("text", F.lit("")), F.col("turn") + 1, _FORMS).alias("trigger")), """
    SELECT conv_id, turn, CASE WHEN contains(m, 'quote') OR contains(m, 'ther') THEN 'quote:keyword' WHEN turn + 1 >= 9 THEN 'quote:messages'
      WHEN (contains(m, 'where')::INT + contains(m, 'that')::INT + contains(m, 'into')::INT) * 100 >= 180 THEN 'support:question'
      WHEN (contains(m, 'they')::INT + contains(m, 'will')::INT + contains(m, 'come')::INT + contains(m, 'back')::INT) * 100 >= 240 THEN 'support:question'
      WHEN turn + 1 >= 3 THEN 'survey:messages' END AS "trigger" FROM (SELECT *, lower(coalesce(text, '')) AS m FROM conversations WHERE role = 'user')""")

_QUERIES = """SELECT * FROM (VALUES (1, 'Chi sono  gli assessori?'), (2, 'potresti dirmi gli orari dello sportello...'), (3, 'SOW template'), (4, 'l''elenco dei consiglieri'),
    (5, 'vorrei sapere la composizione della giunta'), (6, '?!'), (7, 'telefono e orari di apertura'), (8, 'tutti i consiglieri'), (9, 'elenco completo uffici'), (10, 'sindaco e amministrativo'), (11, 'servizi uffici e settori'), (12, 'i 23 consiglieri'),
    (13, 'tutte e 16'), (14, 'ciascun membro della giunta e consiglio'), (15, 'organi politico-amministrativi'), (16, 'tutta l''amministrazione'), (17, 'struttura completa del comune')) AS t(id, query)"""
_NORMALISED = "regexp_replace(trim(query), '[?!.]+$', '')"
for _pattern, _to in answers.LEAD_INS:
    _NORMALISED = f"regexp_replace({_NORMALISED}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_to.replace('$', chr(92))}', 'g')"
add_derived("X1_normalised_query", {"q": spread(_QUERIES, 17, "query", PARTS, "k", "query")}, lambda q: q.select("id", answers.normalise_query(F.col("query")).alias("query")),
    f"SELECT id, CASE WHEN x = '' THEN query ELSE x END AS query FROM (SELECT *, trim(regexp_replace({_NORMALISED}, '\\s+', ' ', 'g')) AS x FROM q)")

_HITS = {t: _count("lower(query)", w) for t, w in answers.COMPLETE_TOPICS.items()}
_BY_PATTERN = " OR ".join("regexp_matches(query, '{}')".format(p.replace("'", "''")) for p in answers.COMPLETE_PATTERNS)
_FIRST = lambda least, value: "CASE " + " ".join(f"WHEN {h} >= {least} THEN {value(t, h)}" for t, h in _HITS.items()) + " END"
add_derived("X11_completeness", {"q": spread(_QUERIES, 17, "query", PARTS, "k", "query")}, lambda q: q.select("id", answers.completeness(F.col("query")).alias("c")).select("id", "c.*"),
    f"""SELECT id, p OR topic IS NOT NULL AS complete, CASE WHEN p THEN 'pattern' WHEN topic IS NOT NULL THEN 'topic' ELSE 'normal' END AS kind, CASE WHEN p THEN first ELSE topic END AS topic,
    CASE WHEN p THEN 0.9 WHEN topic IS NOT NULL THEN least(0.95, round(0.7 + n * 0.1, 2)) ELSE 0 END::DOUBLE AS confidence
    FROM (SELECT *, ({_BY_PATTERN}) AS p, {_FIRST(2, lambda t, h: f"'{t}'")} AS topic, {_FIRST(1, lambda t, h: f"'{t}'")} AS first, {_FIRST(2, lambda t, h: h)} AS n FROM q)""")

_KEYWORDS = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(i, w.replace("'", "''")) for i, words in answers.INTENT_WORDS.items() for w in words) + ") AS t(intent, keyword)"
_NAMED = """SELECT * FROM (VALUES (1, 'Qual è il numero di telefono di'), (2, 'mi puoi dire gli orari di apertura:'), (3, 'dove? indirizzo della sede'), (4, 'what is the phone number -'), (5, 'telefono')) AS t(id, query)"""
_PHRASES = "|".join(re.escape(p).replace("\\ ", " ").replace("'", "''") for p in dict.fromkeys((*sorted(answers.REMOVALS, key=lambda p: -len(p)), *answers.NAMED_BY["phone"])))
# blanks around every word, so that boundaries are blanks on both sides
add_derived("X10_entity_name", {"q": spread(_NAMED, 5, "query", PARTS, "k", "query")}, lambda q: q.select("id", cascade.entity_name(F.col("query"), "phone").alias("name")), rf"""
    SELECT id, trim(regexp_replace(regexp_replace(' ' || regexp_replace(regexp_replace(lower(trim(query)), '[-?.!,:;"''`“”’]', ' ', 'g'), '\s+', '  ', 'g') || ' ', ' (?:{_PHRASES.replace(" ", "  ")}) ', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM q""")
_ASKED = """SELECT * FROM (VALUES (1, 'orari di apertura', 'orari di apertura'), (2, 'telefono ufficio', 'telefono ufficio cellulare'), (3, 'where is the office', 'where is the office address'), (4, 'pec', 'pec email'), (5, 'qualcosa di molto lungo e diverso', 'altro')) AS t(id, query, expanded)"""
_ASKED_BY = spread(_ASKED, 5, "query expanded", TURNS.replace("coalesce(text, '')", "lower(coalesce(text, ''))"), "k", "query expanded")
_INTENTS = """, m AS (SELECT id, intent, sum(CASE WHEN contains(query, keyword) THEN length(keyword) / greatest(length(query), 1)::DOUBLE WHEN contains(expanded, keyword) THEN length(keyword) / greatest(length(query), 1)::DOUBLE * 0.5 ELSE 0 END) AS score
    FROM q CROSS JOIN (SELECT DISTINCT intent, keyword FROM k) GROUP BY 1, 2), r AS (SELECT id, intent, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, intent)::INT AS "rank" FROM m WHERE score >= 0.3)"""
_ROUNDED = ["id", "intent", "round(score, 6) as score", "rank"]
add_derived("X9_intents", {"q": _ASKED_BY, "k": _KEYWORDS}, lambda q, k: answers.intents(q, k).selectExpr(*_ROUNDED), _INTENTS + " SELECT * FROM r")
add_derived("X9_first_intent", {"q": _ASKED_BY, "k": _KEYWORDS}, lambda q, k: answers.intents(q, k, first_only=True).selectExpr(*_ROUNDED), _INTENTS + ' SELECT * FROM r WHERE "rank" = 1')

_BOOSTS = answers.Boosts(base=1.1, upload=1.5, title_words={"brass": 1.2, "STEEL": 0.9, "tin": -1.0}, locations={"green": 2.0})
add("R5_boosts", "part", lambda p: p.select("p_partkey", F.round(answers.boosted(F.col("p_retailprice"), F.when(F.col("p_size") < 10, "upload").otherwise("web"), F.col("p_type"), F.col("p_name"), _BOOSTS), 4).alias("score")),
    """SELECT p_partkey, round(p_retailprice * 1.1::DOUBLE * CASE WHEN p_size < 10 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN contains(lower(p_type), 'brass') THEN 1.2 ELSE 1.0 END::DOUBLE
    * CASE WHEN contains(lower(p_type), 'steel') THEN 0.9 ELSE 1.0 END::DOUBLE * CASE WHEN contains(lower(p_name), 'green') THEN 2.0 ELSE 1.0 END::DOUBLE, 4) AS score FROM part""")
add("R19_retry_size", "part", lambda p: p.select("p_partkey", answers.retry_size(F.col("p_partkey")).alias("k")), "SELECT p_partkey, least(50, greatest(10, floor(p_partkey * 0.2)))::INT AS k FROM part")
