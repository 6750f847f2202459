"""What decides about answers: citation scores, gating, intents, completeness, boosts and form triggers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# They must equal those of existing deployments.
GOOD_FILES = ("pdf", "doc", "docx")
OFFICIAL_HOSTS = (".gov.", ".edu.", "comune.", "regione.", "provincia.")
AUTHORITY_WORDS = (
    "comune", "regione", "provincia", "ministero", "ufficio", "delibera", "ordinanza", "regolamento", "statuto", "pnrr", "pgtu", "piano", "ufficiale", "municipio",
)
CITATION_WEIGHTS = {"source": 0.20, "quality": 0.30, "authority": 0.25, "intent_match": 0.25}
#: Keywords by intent, Italian and English; others come as a parameter.
INTENT_WORDS = {
    "thanks": (
        "grazie", "grazie mille", "ti ringrazio", "la ringrazio", "vi ringrazio", "molte grazie", "tante grazie", "grazie tante", "grazie di tutto", "grazie per tutto", "grazie dell'aiuto",
        "grazie per l'aiuto", "grazie per la risposta", "perfetto grazie", "ok grazie", "ottimo", "perfetto", "bene", "molto bene", "eccellente", "fantastico", "sei stato di aiuto", "sei stata utile",
        "molto utile", "molto gentile", "la ringrazio sentitamente", "cordiali ringraziamenti", "distinti saluti", "cordiali saluti", "buona giornata", "buon lavoro", "arrivederci",
        "thanks", "thank you", "thank you very much", "thanks a lot", "many thanks", "thanks so much", "appreciate it", "much appreciated", "perfect thanks", "great thanks", "excellent", "perfect",
        "awesome", "wonderful", "you've been helpful", "very helpful", "very kind", "good job", "have a nice day", "goodbye", "bye", "see you",
    ),
    "schedule": (
        "orario", "orari", "orario di apertura", "orari di apertura", "quando è aperto", "quando apre", "quando chiude", "a che ora", "apertura", "chiusura", "aperto", "chiuso", "ore",
        "lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica", "festivi", "feriali", "weekend", "mattina", "pomeriggio", "sera", "ricevimento", "sportello", "ufficio orari", "servizio clienti",
        "schedule", "hours", "opening hours", "opening times", "when open", "when does it open", "what time", "open", "closed", "business hours",
    ),
    "address": (
        "indirizzo", "residenza", "domicilio", "sede", "ubicazione", "dove si trova", "dove è", "via", "viale", "piazza", "corso", "largo", "vicolo", "strada", "p.zza", "posizione", "località", "zona", "quartiere", "dove", "ufficio",
        "address", "residence", "headquarters", "office", "location", "street", "st.", "avenue", "ave", "road", "rd", "square", "lane", "boulevard", "blvd",
    ),
    "email": ("email", "e-mail", "mail", "posta", "posta elettronica", "indirizzo email", "indirizzo e-mail", "pec", "email address"),
    "phone": (
        "telefono", "numero di telefono", "numero", "tel", "cellulare", "cell", "recapito telefonico", "contatto telefonico", "mobile", "fisso", "centralino", "chiamare", "telefonare",
        "emergenza", "pronto soccorso", "118", "112", "113", "115", "117", "protezione civile", "contatto", "contatti", "recapito",
        "phone", "telephone", "phone number", "number", "cellphone", "contact", "contacts", "landline",
    ),
}
#: Phrases that are no part of a name: common, Italian, English; and the words of each intent.
REMOVALS = (
    "di", "del", "della", "dello", "dei", "degli", "delle", "il", "lo", "la", "i", "gli", "le", "per favore", "perfavore", "per cortesia", "grazie",
    "mi puoi dire", "mi sai dire", "puoi dirmi", "potresti dirmi", "sapresti", "mi trovi", "mostrami", "dimmi", "indicami", "fornisci", "dammi", "trova", "cerca", "qual è", "numero di telefono", "telefono", "tel", "cellulare",
    "recapito", "contatto", "contatti", "email", "e-mail", "mail", "posta", "pec", "indirizzo", "residenza", "sede", "via", "viale", "piazza", "corso", "largo", "vicolo", "mobile", "fisso",
    "can you tell me", "could you tell me", "would you tell me", "please tell me", "tell me", "show me", "find", "search", "what is", "what's", "phone number", "phone", "telephone", "cell", "contact", "email address",
    "address", "residence", "headquarters", "office", "street", "avenue", "road",
)
NAMED_BY = {
    "schedule": ("orario", "orari", "quando", "apertura", "chiusura", "aperto", "chiuso", "ore"),
    "phone": ("telefono", "numero", "tel", "cellulare", "mobile", "fisso", "contatto", "recapito"),
    "email": ("email", "e-mail", "mail", "posta", "pec"),
    "address": ("indirizzo", "residenza", "domicilio", "sede", "ubicazione"),
}
#: Topics that ask for every entry, in order of precedence.
COMPLETE_TOPICS = {
    "consiglieri": ("consigliere", "consiglieri", "consiglio comunale", "presidente consiglio"),
    "assessori": ("assessore", "assessori", "giunta", "vice sindaco"),
    "organi_politici": ("organi politico", "amministrativo", "politico-amministrativo", "sindaco"),
    "servizi": ("servizi", "uffici", "dipartimenti", "settori"),
    "contatti": ("contatti", "telefoni", "numeri", "indirizzi"),
    "orari": ("orari", "apertura", "chiusura", "ricevimento"),
}
COMPLETE_PATTERNS = (
    r"(?i)\b(?:tutti|tutte)\s+(?:i|le|gli)?\s*(?:consiglieri|assessori|membri|sindaci)",
    r"(?i)\belenco\s+(?:completo|totale|integrale)",
    r"(?i)\b(?:elenco|lista)\s+(?:di\s+)?(?:tutti|tutte)",
    r"(?i)\b(?:completo|completa|intero|intera|totale)\s+(?:elenco|lista)",
    r"(?i)\b(?:23|ventitr[eè]|16|sedici)\s+(?:consiglieri|membri|persone)",
    r"(?i)\btut[it]e?\s+(?:e\s+)?(?:23|ventitr[eè]|16|sedici)",
    r"(?i)\b(?:ogni|ciascun[oa]?|qualsiasi)\s+(?:consigliere|assessore|membro)",
    r"(?i)\bsenza\s+(?:eccezioni?|esclusioni?)",
    r"(?i)\b(?:giunta\s+e\s+consiglio|consiglio\s+e\s+giunta)",
    r"(?i)\borgani\s+politico[-\s]?amministrativ[io]",
    r"(?i)\b(?:chi\s+sono\s+tutti|quali\s+sono\s+tutti)\s+(?:i|gli)\s+(?:consiglieri|assessori)",
    r"(?i)\b(?:nomi\s+di\s+tutti|nomi\s+completi)",
    r"(?i)\b(?:intera\s+amministrazione|tutta\s+l'amministrazione)",
    r"(?i)\b(?:composizione\s+(?:completa|totale))",
    r"(?i)\b(?:struttura\s+(?:completa|totale))\s+(?:del\s+)?(?:comune|consiglio|giunta)",
    r"(?i)\b(?:tutti|tutte)\s+(?:i|le|gli)?\s*(?:servizi|uffici|dipartimenti)",
    r"(?i)\b(?:elenco|lista)\s+(?:servizi|uffici|contatti)",
    r"(?i)\b(?:orari\s+di\s+tutti|numeri\s+di\s+tutti)",
)
#: Lead-ins of formal questions and what stays of them, applied in order.
LEAD_INS = (
    (r"(?i)^chi\s+sono\s+(.+)$", "$1"),
    (r"(?i)^quali\s+sono\s+(.+)$", "$1"),
    (r"(?i)^potresti\s+dirmi\s+(.+)$", "$1"),
    (r"(?i)^vorrei\s+conoscere\s+(.+)$", "$1"),
    (r"(?i)^.*mi\s+serve\s+sapere\s+(.+)$", "$1"),
    (r"(?i)^ho\s+bisogno\s+di\s+(.+)$", "$1"),
    (r"(?i)^.*composizione\s+(di\s+|del\s+|della\s+)?(.+)$", "$2"),
    (r"(?i)^l'elenco\s+(.+)$", "elenco $1"),
    (r"(?i)\bsow\b", "statement of work sow"),
)


def _holds(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def source_score(source: Column, url: Column) -> Column:
    """0.5, with 0.3 for a document file and 0.2 for an official host."""
    source, url = F.lower(source), F.lower(url)
    files = [f".{x}" for x in GOOD_FILES]
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(_any(source, files) | _any(url, files), 0.3).otherwise(0.0) + F.when(_any(url, OFFICIAL_HOSTS), 0.2).otherwise(0.0))


def content_score(content: Column) -> Column:
    """By length, best from 200 to 1,000 characters, with 0.15 for a table or a list."""
    n = F.length(content)
    by_length = F.when(n < 50, 0.2).when(n < 200, 0.5).when(n <= 1000, 1.0).when(n <= 2000, 0.8).otherwise(0.6)
    structured = F.contains(content, F.lit("|")) | F.contains(content, F.lit("Nominativo")) | content.rlike(r"(?m)^\s*[-*•]\s")
    return F.least(F.lit(1.0), by_length + F.when(structured, 0.15).otherwise(0.0))


def authority_score(everything: Column, has_metadata: Column) -> Column:
    """0.3, with 0.15 for each word of authority up to three, and 0.1 for metadata."""
    words = F.least(F.lit(0.45), _holds(F.lower(everything), AUTHORITY_WORDS) * 0.15)
    return F.least(F.lit(1.0), F.lit(0.3) + words + F.when(has_metadata, 0.1).otherwise(0.0))


def intent_score(content: Column, query: Column, intent: Column, phone: Column, email: Column) -> Column:
    """0.6 of the share of query words of over three letters in the content, with a boost for what the intent asks for."""
    low = F.lower(content)
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.length(w) > 3)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    share = F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.5)
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    address = _any(low, ("via ", "piazza ", "indirizzo"))
    hours = F.contains(low, F.lit(":")) & _any(low, ("orari", "apertura"))
    boost = (
        F.when(intent == "phone", F.when(filled(phone), 0.4).otherwise(0.0))
        .when(intent == "email", F.when(filled(email), 0.4).otherwise(0.0))
        .when(intent == "address", F.when(address, 0.3).otherwise(0.0))
        .when(intent.isin("hours", "schedule"), F.when(hours, 0.3).otherwise(0.0))
        .otherwise(0.0)
    )
    return F.least(F.lit(1.0), share * 0.6 + boost)


def score_citations(citations: DataFrame, *, least: float = 0.30, weights: dict[str, float] = CITATION_WEIGHTS) -> DataFrame:
    """The citations with a composite score of at least ``least``, with the score and its parts.

    Reads content, source, url, title, has_metadata, phone, email, query, intent
    and score (null: 1); rows without content go. Scores have four decimals.
    """
    filled = citations.filter(F.trim(_text("content")) != "")
    everything = F.concat_ws(" ", _text("title"), _text("source"), F.col("content"), _text("url"))
    parts = {
        "source": source_score(_text("source"), _text("url")),
        "quality": content_score(F.col("content")),
        "authority": authority_score(everything, F.coalesce("has_metadata", F.lit(False))),
        "intent_match": intent_score(F.col("content"), _text("query"), _text("intent"), F.col("phone"), F.col("email")),
    }
    scored = filled.withColumns({f"{k}_score": v for k, v in parts.items()})
    whole = reduce(lambda a, b: a + b, (F.col(f"{k}_score") * w for k, w in weights.items())) * F.coalesce("score", F.lit(1.0))
    scored = scored.withColumn("composite", whole).filter(F.col("composite") >= least)
    return scored.withColumns({c: F.round(c, 4) for c in ("composite", *(f"{k}_score" for k in parts))})


def falls_back(citations: Column, confidence: Column, *, least_citations: int = 1, least_confidence: float = 0.05, force: bool = True) -> Column:
    """Whether an answer gives way to the stock message: too few citations or too little confidence, unless any citation forces it."""
    weak = (citations < least_citations) | (confidence < least_confidence)
    return weak & ~(F.lit(force) & (citations > 0))


def normalise_query(query: Column) -> Column:
    """Without closing marks and formal lead-ins, one acronym spelled out, single spaces; the query itself if nothing is left."""
    out = F.regexp_replace(F.trim(query), r"[?!.]+$", "")
    for pattern, to in LEAD_INS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(to))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(out == "", query).otherwise(out)


def intents(queries: DataFrame, keywords: DataFrame, *, query_col: str = "query", expanded_col: str = "expanded", least: float = 0.3, first_only: bool = False) -> DataFrame:
    """``queries`` with (intent, score, rank), a row for each intent that reaches ``least``.

    ``keywords``: (intent, keyword). A keyword in the query scores its share of
    the query's length, one in the expanded query alone half of that. Keywords
    are configuration, so they are gathered into one row that goes to every
    query. Equal scores rank by intent.
    """
    table = keywords.distinct().groupBy("intent").agg(F.sort_array(F.collect_list("keyword")).alias("words")).agg(F.sort_array(F.collect_list(F.struct("intent", "words"))).alias("intents"))
    low, more = F.lower(query_col), F.lower(expanded_col)
    n = F.greatest(F.length(low), F.lit(1))

    def score(words: Column) -> Column:
        part = lambda w: F.when(F.contains(low, w), F.length(w) / n).when(F.contains(more, w), F.length(w) / n * 0.5).otherwise(0.0)
        return F.aggregate(words, F.lit(0.0), lambda s, w: s + part(w))

    every = queries.join(F.broadcast(table), how="cross")  # one row of configuration
    scored = every.select(*queries.columns, F.explode("intents").alias("i")).select(*queries.columns, "i.intent", score(F.col("i.words")).alias("score")).filter(F.col("score") >= least)
    order = Window.partitionBy(*queries.columns).orderBy(F.desc("score"), "intent")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked.filter("rank = 1") if first_only else ranked


def completeness(query: Column) -> Column:
    """Whether a query asks for every entry: (complete, kind, topic, confidence)."""
    low = F.lower(query)
    by_pattern = reduce(lambda a, b: a | b, (query.rlike(p) for p in COMPLETE_PATTERNS))
    hits = {t: _holds(low, words) for t, words in COMPLETE_TOPICS.items()}
    topic, n, any_topic = F.lit(None).cast("string"), F.lit(0), F.lit(None).cast("string")
    for t in reversed(COMPLETE_TOPICS):
        topic, n = F.when(hits[t] >= 2, F.lit(t)).otherwise(topic), F.when(hits[t] >= 2, hits[t]).otherwise(n)
        any_topic = F.when(hits[t] >= 1, F.lit(t)).otherwise(any_topic)
    fields = lambda complete, kind, topic, sure: F.struct(F.lit(complete).alias("complete"), F.lit(kind).alias("kind"), topic.alias("topic"), sure.alias("confidence"))
    by_topic = fields(True, "topic", topic, F.least(F.lit(0.95), F.round(F.lit(0.7) + n * 0.1, 2)))
    return F.when(by_pattern, fields(True, "pattern", any_topic, F.lit(0.9))).when(topic.isNotNull(), by_topic).otherwise(fields(False, "normal", F.lit(None).cast("string"), F.lit(0.0)))


@dataclass(frozen=True)
class Boosts:
    """Factors of a tenant's retrieval; those of keywords that are not positive count for nothing."""

    base: float = 1.0
    upload: float = 1.0
    title_words: dict[str, float] = field(default_factory=dict)
    locations: dict[str, float] = field(default_factory=dict)


def boosted(score: Column, source: Column, title: Column, query: Column, boosts: Boosts) -> Column:
    """The score times the factors that apply: base, uploaded document, words of the title, places in the query."""
    out = score * boosts.base
    if boosts.upload > 0:
        out = out * F.when(source == "upload", boosts.upload).otherwise(1.0)
    for text, table in ((title, boosts.title_words), (query, boosts.locations)):
        for word, factor in table.items():
            if word and factor > 0:
                out = out * F.when(F.contains(F.lower(text), F.lit(word.lower())), factor).otherwise(1.0)
    return out


def retry_size(k: Column) -> Column:
    """How many candidates a second, semantic search asks for: a fifth, from 10 to 50."""
    return F.least(F.lit(50), F.greatest(F.lit(10), F.floor(k * 0.2))).cast("int")


@dataclass(frozen=True)
class Form:
    name: str
    words: tuple[str, ...] = ()
    after_messages: int | None = None
    questions: tuple[str, ...] = ()


def form_trigger(message: Column, count: Column, forms: Sequence[Form]) -> Column:
    """``form:reason`` of the first form that a message triggers: by keyword, by number of messages, or by a question.

    A question matches if at least 60 % of its words of over three letters stand in the message.
    """
    low, out = F.lower(message), F.lit(None).cast("string")
    for form in reversed(forms):
        for question in reversed(form.questions):
            words = [w for w in question.lower().split(" ") if len(w) > 3]
            if words:
                out = F.when(_holds(low, words) * 100 >= 60 * len(words), F.lit(f"{form.name}:question")).otherwise(out)
        if form.after_messages:
            out = F.when(count >= form.after_messages, F.lit(f"{form.name}:messages")).otherwise(out)
        if words := [w.strip().lower() for w in form.words if w.strip()]:
            out = F.when(_any(low, words), F.lit(f"{form.name}:keyword")).otherwise(out)
    return out


# Fixed values of the five-factor score.
LISTED = r"[-•·]\s+|\d+\.\s+|\n\s*\n"
CONTACT = r"(?i)\b(?:telefono|email|indirizzo|orari?|contatti?)\b"
SIGNS = (r"(?:\+39\s*)?0\d{1,3}[\s.\-]*\d{6,8}", r"@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"(?i)\b(?:via|viale|piazza|corso|largo)\s+[A-Z]", r"\d{1,2}[:.]?\d{0,2}\s*[-–—]\s*\d{1,2}[:.]?\d{0,2}")
HOSTS = r"(?i)\.(gov|edu|org|comune\.|provincia\.|regione\.)"
OFFICES = r"(?i)\b(?:comune|provincia|regione|ufficio|servizio|informazioni)\b"


def five_factors() -> Column:
    """Score of a citation (q, position, score, text, snippet, title, url, kind, contact fields) among those of its query.

    0.35 of its score, 0.25 of its content, 0.2 of its contacts, 0.15 of its
    source's authority and 0.05 of its position, 1 falling to 0 at the end.
    """
    text, url, title = _text("text"), _text("url"), _text("title")
    given = lambda cond, points: F.when(cond, points).otherwise(0.0)
    content = F.when(F.length(text) > 800, 0.3).when(F.length(text) > 400, 0.2).when(F.length(text) > 200, 0.1).otherwise(0.0)
    content = content + given(F.length(_text("snippet")) > 150, 0.2) + given(F.length(title) > 10, 0.2) + given(text.rlike(LISTED), 0.15) + given(text.rlike(CONTACT), 0.15)
    filled = reduce(lambda a, b: a + b, ((_text(c) != "").cast("int") for c in ("phone", "email", "address", "schedule")))
    contacts = filled * 0.25 + given(filled >= 2, 0.1) + reduce(lambda a, b: a + b, (given(text.rlike(p), 0.1) for p in SIGNS))
    kind = F.lower(_text("kind"))
    source = given(url.rlike(HOSTS), 0.4) + F.when(kind == "pdf", 0.2).when(kind.isin("doc", "docx"), 0.15).when(kind.isin("txt", "md"), 0.1).otherwise(0.0)
    source = source + given(url.rlike("/[^/]+/[^/]+"), 0.15) + given(title.rlike(OFFICES), 0.15) - given(F.length(url) > 150, 0.1)
    n = F.count("*").over(Window.partitionBy("q"))
    place = F.greatest(F.lit(0.0), 1 - (F.col("position") - 1) / F.greatest(F.lit(1), n - 1))
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.coalesce("score", F.lit(0.0)) * 0.35 + one(content) * 0.25 + one(contacts) * 0.2 + one(source) * 0.15 + place * 0.05


def conversation_context(messages: DataFrame, key: str, turn: str, role: str, text: str, *, most: int = 10, size: int = 200) -> DataFrame:
    """(key, turn, messages, context) of every user message with something before it.

    Of the ``most`` messages before it those of user and assistant count, unless
    empty or injected; each is cut to ``size`` characters.
    """
    body = F.trim(_text(text))
    line = F.concat(F.col(role), F.lit(": "), F.when(F.length(body) > size, F.concat(F.substring(body, 1, size), F.lit("..."))).otherwise(body))
    useful = F.col(role).isin("user", "assistant") & (body != "") & ~F.startswith(body, F.lit("Contesto della knowledge base"))
    before = Window.partitionBy(key).orderBy(turn).rowsBetween(-most, -1)
    lines = F.collect_list(F.when(useful, line)).over(before)
    rows = messages.withColumn("_lines", lines).filter((F.col(role) == "user") & (F.size("_lines") > 0))
    return rows.select(key, turn, F.size("_lines").alias("messages"), F.array_join("_lines", "\n").alias("context"))
