"""Contacts near names, answer types, sharper queries, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contacts
from .registry import PARTS, TURNS, add, add_derived, spread

_CHUNKS = """SELECT * FROM (VALUES (1, 0, 'Ufficio Anagrafe di Mario Rossi: tel. 06 1234567, cell. 333 123 4567, email mario.rossi@example.org'), (1, 1, 'Per emergenze chiamare il 112. Il signor Rossi risponde con Mario allo 0612345678.'), (2, 0, 'Contatti generali: info@example.org'),
    (3, 0, 'Rossi scrive a posta@example.org e mario@example.net'), (4, 0, NULL)) AS t(doc, part, content)"""
_NUMBERED = f"SELECT row_number() OVER (ORDER BY doc, part) AS id, content FROM ({_CHUNKS})"
_NEAR_CHUNKS = f"SELECT id AS doc, 0 AS part, content FROM ({spread(_NUMBERED, 5, 'content', '(SELECT doc_id, translate(text, chr(64) || chr(35) || 0123456789, chr(32)) AS text FROM documents)', 'doc_id', 'content')})"
_TRI = lambda c: f"list_distinct(list_transform(range(1, greatest(2, length({c}) - 1)), lambda i: substr({c}, i, 3)))"
_NEAR = f""", b AS (SELECT doc, part, content AS t, lower(content) AS low, len(list_intersect({_TRI('lower(content)')}, {_TRI("'mario rossi'")})) / len(list_distinct(list_concat({_TRI('lower(content)')}, {_TRI("'mario rossi'")})))::DOUBLE AS sim FROM c WHERE content IS NOT NULL),
n AS (SELECT *, CASE WHEN contains(low, 'mario rossi') THEN instr(low, 'mario rossi') - 1 WHEN contains(low, 'mario') AND contains(low, 'rossi') THEN (instr(low, 'mario') + instr(low, 'rossi') - 2) // 2 END AS name_at FROM b)"""
_SCORE = "sim + greatest(0, 1 - least(CASE WHEN name_at IS NULL THEN 9999 ELSE abs(instr(t, raw) - 1 - name_at) END, 500) / 500.0::DOUBLE)"
add_derived("E2_mails_near_name", {"c": _NEAR_CHUNKS}, lambda c: contacts.near_name(c, ["doc", "part"], "content", "Mario Rossi", "email", None).select("doc", "part", "value", F.round("score", 6).alias("score")),
    _NEAR + f" SELECT doc, part, raw AS value, round({_SCORE}, 6) AS score FROM (SELECT *, unnest(regexp_extract_all(t, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}')) AS raw FROM n WHERE contains(low, 'mario') OR contains(low, 'rossi'))")
_PHONES = ["06 1234567", "333 123 4567", "112", "0612345678"]
add_derived("E1_phones_near_name", {"c": _NEAR_CHUNKS}, lambda c: contacts.near_name(c, ["doc", "part"], "content", "Mario Rossi", "phone", None).select("doc", "part", "value", F.round("score", 6).alias("score")),
    _NEAR + f""", p AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in _PHONES)}) AS t(raw)) SELECT doc, part, replace(raw, ' ', '') AS value, round({_SCORE}, 6) AS score FROM n JOIN p ON contains(t, raw) WHERE contains(low, 'mario') AND contains(low, 'rossi')""")
_ANSWERS = "SELECT * FROM (VALUES (1, 'Ecco: 📞 **Telefono:** 06 1' ), (2, '📍 **Indirizzo:** via Roma 📧 **Email:** a@b.c'), (3, 'Non so')) AS t(id, answer)"
add_derived("X58_answer_types", {"a": spread(_ANSWERS, 3, "answer", TURNS, "k", "answer")}, lambda a: a.select("id", F.array_join(contacts.answer_types(F.col("answer")), ",").alias("types")),
    "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(answer, '{label}') THEN '{kind}' END" for kind, label in contacts.LABELS.items()) + ") AS types FROM a")
_QUERIES = "SELECT * FROM (VALUES (1, ' quando apre la sede? '), (2, 'numero verde'), (3, 'tariffe'), (4, 'Che cosa è il progetto \"Aria\"?'), (5, 'dimmi'), (6, 'dove scrivere: email, posta!')) AS t(id, query)"
add_derived("X76_sharpened", {"q": spread(_QUERIES, 6, "query", PARTS, "k", "query")}, lambda q: q.select("id", contacts.sharpened(F.col("query")).alias("query")),
    "SELECT id, concat_ws(' ', trim(query), " + ", ".join(f"CASE WHEN regexp_matches(query, '(?i)\\b(?:{w})\\b') THEN '{m}' END" for w, m in contacts.SHARPER) + ") AS query FROM q")
_VAGUE = "query"
for _words in contacts.VAGUE[1:2] + contacts.VAGUE[3:5]:
    _VAGUE = f"regexp_replace({_VAGUE}, '(?i)\\b(?:{_words})\\b', ' ', 'g')"
_PLAIN = "SELECT * FROM (VALUES (1, 'dimmi gli orari: anagrafe!'), (2, 'vorrei sapere il costo del progetto'), (3, 'dimmi'), (4, 'tasse \"locali\"')) AS t(id, query)"
add_derived("X2_base_query", {"q": spread(_PLAIN, 4, "query", PARTS, "k", "query")}, lambda q: q.select("id", contacts.without_vague(F.col("query")).alias("query")),
    f"SELECT id, CASE WHEN length(x) < 3 THEN query ELSE x END AS query FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_VAGUE}, '[\"''`]', '', 'g'), '[?.!;,:]', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM q)")
_ROWS = "SELECT url || ' ' || page_id AS url, CAST(page_id % 5 + 1 AS INT) AS version, substr(html, 1, 300) AS content FROM pages"
_FETCHED = """SELECT CASE WHEN page_id % 3 = 0 THEN 'new ' ELSE '' END || url || ' ' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'changed ' ELSE '' END || substr(html, 1, 300) AS content, 1 AS at_time FROM pages
    UNION ALL SELECT url || ' ' || page_id, CASE WHEN page_id % 4 = 1 THEN 'newer ' ELSE '' END || substr(html, 1, 300), 2 FROM pages WHERE length(html) > 2500"""
add_derived("G4_versions", {"r": _ROWS, "f": _FETCHED}, lambda r, f: contacts.refreshed(r, f, "url", "at_time"), """, l AS (SELECT url, arg_max(content, at_time) AS fresh FROM f GROUP BY 1)
    SELECT coalesce(r.url, l.url) AS url, CASE WHEN version IS NULL THEN 1 WHEN fresh <> content THEN version + 1 ELSE version END AS version, coalesce(fresh, content) AS content FROM r FULL JOIN l ON r.url = l.url""")
add("W10_last_five", "orders", lambda o: contacts.history(o, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 5")
