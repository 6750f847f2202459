"""Text of pages and forms: titles, Markdown, positions, schedules, phones, fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of existing deployments.
ESCAPED = ("\\", "`", "*", "_", "{", "}", "[", "]", "(", ")", "#", "+", "-", "!", "|")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
URGENT = ("urgente", "immediato", "emergenza", "subito", "blocco")
HIGH = ("problema", "errore", "non funziona", "aiuto")
EMERGENCY = ("112", "113", "115", "117", "118", "1515", "1530", "1533", "114")
MAIL_FIELDS = ("email", "mail", "e_mail", "user_email", "email_address", "Email", "Mail", "E_mail")
NAME_FIELDS = ("name", "nome", "full_name", "user_name", "first_name", "cognome", "nome_cognome")
MAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"
PHONES = r"\b(?:\d{2,4}[\s\-]?){2,4}\d{2,4}\b"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def sentence_safe(text: Column, most: int = 800, cut: int = 750, least: int = 500) -> Column:
    """Single blanks; a text beyond ``most`` ends with its last full sentence in ``cut`` characters, or with dots where that is too early."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(one, 1, cut)
    last = F.length(head) - F.instr(F.reverse(head), ".")  # position of the last full stop, from 0
    stop = (F.instr(head, ".") > 0) & (last > least)
    return F.when(F.length(one) <= most, one).when(stop, F.substr(one, F.lit(1), last + 1)).otherwise(F.concat(head, F.lit("...")))


def decoded(text: Column) -> Column:
    """With the common character entities replaced; others stay."""
    return reduce(lambda c, e: _replace(c, *e), ENTITIES.items(), text)


def clean_title(title: Column) -> Column:
    """Without entities, tags, the suffix of scraped pages and runs of blanks; null if nothing is left."""
    out = F.regexp_replace(decoded(title), "<[^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)\s*\(Scraped\)$", ""), r"[\s ]+", " ")
    return F.nullif(F.trim(out), F.lit(""))


def page_title(html: Column, strategy: str) -> Column:
    """By ``title``, ``h1`` or ``h1_h2`` (all of both, in order), else by the title; single blanks, at most 512 characters."""
    inner = lambda tag: F.filter(F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    both = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h([12])\b[^>]*>.*?</h\1>"), F.lit(0)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    found = {"title": F.get(inner("title"), 0), "h1": F.get(inner("h1"), 0), "h1_h2": F.nullif(F.array_join(both, " "), F.lit(""))}
    raw = F.coalesce(found[strategy], found["title"])
    clean = F.regexp_replace(F.regexp_replace(decoded(raw), "<[^>]*>", ""), r"\s+", " ")
    return F.nullif(F.trim(F.substring(clean, 1, 512)), F.lit(""))


def escape_markdown(text: Column) -> Column:
    """Marks with a meaning in Markdown get a backslash; full stops too, but not before a digit."""
    out = reduce(lambda c, m: _replace(c, m, "\\" + m), ESCAPED, text)
    return F.regexp_replace(out, r"\.(?!\d)", r"\\.")


def escape_link_text(text: Column) -> Column:
    return reduce(lambda c, m: _replace(c, m, "\\" + m), ("\\", "[", "]"), text)


def clean_markdown(text: Column) -> Column:
    """Without empty links and lines that are short or hold no word."""
    out = F.regexp_replace(F.regexp_replace(text, r"\[\s*\]\([^)]*\)", ""), r"\[([^\]]+)\]\(\s*\)", "$1")
    kept = F.filter(F.split(out, "\n", -1), lambda x: (F.octet_length(F.trim(x)) > 3) & x.rlike(r"\w"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


CONTACT_LINE = r"(?i)(?:^|\s)tel[:.]?\s*\+?\d|(?<!\d)(?:\+39\s*)?(?:0\d{1,3}|3\d{2})[.\s-]?\d{2,4}[.\s-]?\d{3,4}(?!\d)"
MAIL_LINE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def filtered_lines(markdown: Column) -> Column:
    """Runs of blanks become one and more than one empty line one; of what is left, lines with structure, a phone or an e-mail stay, others if they have ten bytes.

    The words of menus that deployments also drop are all shorter than that.
    """
    out = F.regexp_replace(markdown, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n")
    trimmed = lambda x: F.trim(x, F.lit(" \t\n\r\x00\x0b"))
    # the cheapest test first: few lines are shorter
    keep = lambda x: (F.octet_length(trimmed(x)) >= 10) | trimmed(x).rlike(r"^(#{1,6}\s|[-*+]\s|>\s|```)") | (trimmed(x) == "") | trimmed(x).rlike(CONTACT_LINE) | trimmed(x).rlike(MAIL_LINE)
    return trimmed(F.array_join(F.filter(F.split(out, "\n", -1), keep), "\n"))


def extraction_quality(markdown: Column, html: Column) -> Column:
    """How much of a page its Markdown holds: tables, phones, links and length, from 0 to 1."""
    ratio = lambda got, of: F.when(of > 0, got / of).otherwise(1.0)
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    n, whole = F.octet_length(markdown), F.octet_length(F.regexp_replace(html, "<[^>]*>", ""))
    share = F.when(whole > 0, n / whole).otherwise(0.0)
    score = (
        F.when(F.contains(html, F.lit("<table")) & F.contains(markdown, F.lit("|")), 0.3).otherwise(0.0)
        + ratio(count(markdown, PHONES), count(html, PHONES)) * 0.4
        + ratio(count(markdown, r"\]\("), count(html, "<a ")) * 0.2
        + F.when((share > 0.3) & (share < 0.8), 0.1).otherwise(0.0)
        + F.when(n > 200, 0.15).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


def extraction_strategy(tables: Column, page_type: Column, quality: Column, structured: Column, relevance: Column) -> Column:
    return (
        F.when(tables, "manual_dom_primary")
        .when((page_type == "article_content") & (quality > 0.5), "readability_primary")
        .when(structured & (relevance > 0.6), "hybrid_structured")
        .when(quality < 0.3, "skip_low_quality")
        .otherwise("hybrid_default")
    )


def term_positions(text: Column, terms: list[str], generic: tuple[str, ...] = ()) -> Column:
    """Where the terms of three characters or more start in a lower-cased text, without overlaps of a term with itself; distinct, in order."""
    found = []
    for term in terms:
        needle = term.strip().lower()
        if len(needle) < 3 or term in generic:
            continue
        parts = F.transform(F.split(text, "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), F.length)
        state = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("p")), lambda s, n: F.struct((s["at"] + n + len(needle)).alias("at"), F.array_append(s["p"], s["at"] + n).alias("p")))
        found.append(F.slice(state["p"], 1, F.size(parts) - 1))
    return F.array_sort(F.array_distinct(F.concat(*found))) if found else F.array().cast("array<int>")


def valid_hours(start: Column, end: Column) -> Column:
    """From 7 to 20, the start before the end, by whole hours."""
    hour = lambda c: F.coalesce(F.get(F.split(F.replace(c, F.lit("."), F.lit(":")), ":"), 0).try_cast("int"), F.lit(0))
    a, b = hour(start), hour(end)
    return a.between(7, 20) & b.between(7, 20) & (a < b)


def inferred_schedule(days: Column) -> Column:
    """Likely hours of an office that names three days at most."""
    morning, afternoon = "Martedì e Venerdì: 9:00-12:00 (orario inferito)", "Giovedì: 15:00-17:00 (orario inferito)"
    each = F.transform(days, lambda d: F.when(F.lower(d).isin("martedì", "venerdì"), morning).when(F.lower(d) == "giovedì", afternoon))
    few = F.when(F.size(days) <= 3, F.filter(each, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    both = F.array_contains(days, "martedì") & F.array_contains(days, "venerdì")
    return F.array_distinct(F.concat(few, F.when(both, F.array(F.lit("Apertura: Martedì e Venerdì mattina, Giovedì pomeriggio"))).otherwise(F.array().cast("array<string>"))))


def form_priority(data: Column, trigger: Column) -> Column:
    low = F.lower(data)
    holds = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return F.when(holds(URGENT), "urgent").when(holds(HIGH) | (trigger == "auto"), "high").otherwise("normal")


def user_mail(fields: Column) -> Column:
    """The first usual field of a map that holds an address, else any field named so."""
    usual = [F.when(F.element_at(fields, f).rlike(MAIL), F.element_at(fields, f)) for f in MAIL_FIELDS]
    other = F.filter(F.map_entries(fields), lambda e: F.contains(F.lower(e["key"]), F.lit("email")) & e["value"].rlike(MAIL))
    return F.coalesce(*usual, F.get(other, 0)["value"])


def user_name(fields: Column) -> Column:
    """The first usual field of a map with a name, else any field named so."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    other = F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]).rlike("nome|name") & (F.trim(e["value"]) != ""))
    return F.coalesce(*(filled(F.element_at(fields, f)) for f in NAME_FIELDS), filled(F.get(other, 0)["value"]))


def valid_field(kind: Column, value: Column, required: Column, options: Column) -> Column:
    """Whether a value fits its field: mail, phone, date, number or one of the options (comma-joined)."""
    there = F.coalesce(F.trim(value), F.lit("")) != ""
    fits = (
        F.when(kind == "email", value.rlike(MAIL))
        .when(kind == "phone", value.rlike(r"^[+]?[0-9\s\-()]+$"))
        .when(kind == "date", value.try_cast("date").isNotNull())
        .when(kind == "number", value.try_cast("double").isNotNull())
        .when(kind.isin("select", "radio") & (F.coalesce(options, F.lit("")) != ""), F.array_contains(F.split(options, ","), value))
        .otherwise(True)
    )
    return F.when(there, fits).otherwise(~required)


def unlikely_phone(match: Column, around: Column) -> Column:
    """Whether a run of digits is something else: a tax number, a date, a time, a price, too short or long, or without a usual prefix.

    ``around``: the text near the match, which names what other numbers are. Emergency numbers are phones.
    """
    digits = F.regexp_replace(F.regexp_replace(match, r"[^0-9+]", ""), r"^(\+39|0039)", "")
    low, n = F.lower(around), F.length(digits)
    # a price is the number itself beside a currency, not any number nearby
    itself = F.concat(F.lit(r"\Q"), match, F.lit(r"\E"))
    priced = F.regexp(low, F.concat(F.lit(r"[€$£]\s*"), itself, F.lit("|"), itself, F.lit(r"\s*(?:€|(?:euro?|dollari?|pounds?)\b)")))
    return (
        F.when(digits.isin(*EMERGENCY), False)
        .when((n == 11) & low.rlike(r"\b(?:p\.?iva|partita\s+iva|vat|codice\s+fiscale|cf)\b"), True)
        .when(match.rlike(r"^\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4}$") | match.rlike(r"^\d{2,4}[.\-/]\d{1,2}[.\-/]\d{1,2}$") | digits.rlike(r"^\d{8}$"), True)
        .when(match.rlike(r"^\d{1,2}[.:]\d{2}$"), True)
        .when((n == 5) & low.rlike(r"\b(?:cap|codice\s+postale|via|viale|piazza|corso)\b"), True)
        .when(priced, True)
        .otherwise((n < 6) | (n > 15) | ~digits.rlike(r"^(?:0\d{1,3}|3\d{2}|800|199|892|899|1\d{2,3})"))
    )


def with_synonyms(query: Column, synonyms: dict[str, str]) -> Column:
    """The query and, behind it, the words of every phrase's synonyms that it does not hold: longest phrase first, each word once."""
    low = F.lower(query)
    word = lambda w: rf"(?U)\b\Q{w}\E\b"
    found = F.array().cast("array<string>")
    for phrase in sorted(synonyms, key=lambda p: -len(p)):
        words = [w.lower() for w in synonyms[phrase].replace(",", " ").split()]
        new = F.filter(F.array(*(F.when(~low.rlike(word(w)), F.lit(w)) for w in words)), lambda x: x.isNotNull()) if words else F.array().cast("array<string>")
        found = F.concat(found, F.when(low.rlike(word(phrase.lower())), new).otherwise(F.array().cast("array<string>")))
    found = F.array_distinct(found)
    return F.when(F.size(found) > 0, F.concat(query, F.lit(" "), F.array_join(found, " "))).otherwise(query)
