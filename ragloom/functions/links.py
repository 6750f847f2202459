"""Links in Markdown: which go, which stay, what is wrong with them; and names with their synonyms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must equal those of existing deployments.
NAVIGATION = (
    r"\[(\d+)\]\(https?:\/\/[^)]*pag=\d+[^)]*\)",
    r"\[(\d+)\]\(https?:\/\/[^)]*page=\d+[^)]*\)",
    r"(?i)\[(Pagina\s+)?(successiva?|precedente|next|previous|avanti|indietro)\]\([^)]+\)",
    r"(?i)\[(Prima|Ultima|Home|Homepage)\]\([^)]+\)",
    r"(?i)\[(Menu|Navigazione|Breadcrumb)\]\([^)]+\)",
    r"\[#\]\([^)]+\)",
    r"\[\s*\]\([^)]+\)",
    r"(?i)\[(scarica\s+documento?|download|pdf)\]\([^)]+\)",
    r"\[[^\]]*\]\(javascript:[^)]*\)",
    r"\[[^\]]*\]\(#[^)]*\)",
)
ALLOWED = ("anagrafenazionale.interno.it", "normattiva.it", "gazzettaufficiale.it", "agenziaentrate.gov.it", "inps.it", "pec.it")
GENERIC = ("clicca qui", "leggi tutto", "maggiori informazioni", "dettagli", "continua", "scopri", "vai", "apri", "vedi", "consulta", "modulo", "form", "documenti", "allegati", "download")
TURNING = ("pagina", "next", "previous", "precedente", "successiva", "home", "menu")
RELEVANT = ("comune", "cesareo", "riconoscimento", "figlio", "stato civile", "anagrafe")
NOTE = "\n\n💡 Fonte: "

LINK = r"\[([^\]]+)\]\(([^)]+)\)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """The host of an absolute address; null without one."""
    return F.nullif(F.regexp_extract(url, _HOST, 1), F.lit(""))


def _links(text: Column) -> Column:
    """(whole, text, url) of every Markdown link, in order."""
    parts = [F.regexp_extract_all(text, F.lit(LINK), F.lit(i)) for i in range(3)]
    return F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("whole", "text", "url"), strict=True)))


def _unlinked(text: Column, goes) -> Column:
    """The text with the links for which ``goes`` holds as their plain text; equal links go together."""
    return F.aggregate(_links(text), text, lambda out, x: F.when(goes(x), F.replace(out, x["whole"], x["text"])).otherwise(out))


def without_navigation(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, F.lit(p), F.lit("")), NAVIGATION, text)


def without_foreign(text: Column, source: Column) -> Column:
    """Links to other hosts than the source's become text, but those to public registers; without a source all stay."""
    own = host(source)

    def foreign(x: Column) -> Column:
        at = host(x["url"])
        listed = reduce(lambda a, b: a | b, (F.contains(at, F.lit(d)) for d in ALLOWED))
        return F.coalesce((at != own) & ~listed, F.lit(False))

    return F.when(own.isNull(), text).otherwise(_unlinked(text, foreign))


def without_malformed(text: Column) -> Column:
    """Doubled links are one, escaped slashes plain, titles go, links with blanks in their address are text."""
    out = F.regexp_replace(text, r"\[\[([^\]]+)\]\([^)]+\)\]\([^)]+\)", "[$1]")
    out = F.replace(out, F.lit("\\/"), F.lit("/"))
    out = F.regexp_replace(out, r'\[([^\]]+)\]\(([^")]+)"[^)]*"\)', "[$1]($2)")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\(([^)]+)\]\([^)]+\)", "[$1]($2)")
    return F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\s[^)]*\)", "$1")


def without_irrelevant(text: Column, keywords: Column) -> Column:
    """Generic links without a keyword in text or address become text; without keywords all stay."""

    def goes(x: Column) -> Column:
        low, url = F.lower(x["text"]), F.lower(x["url"])
        hit = F.exists(keywords, lambda k: F.contains(low, k) | F.contains(url, k))
        return is_generic(x["text"]) & ~hit

    return F.when(F.coalesce(F.size(keywords), F.lit(0)) <= 0, text).otherwise(_unlinked(text, goes))


def with_source(text: Column, source: Column) -> Column:
    """A note of the source below a text that still has a link."""
    return F.when(source.isNotNull() & (source != "") & text.rlike(r"\[[^\]]+\]\([^)]+\)"), F.concat(text, F.lit(NOTE), source)).otherwise(text)


VALID = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/?#]+\S*$"


def is_valid(url: Column) -> Column:
    """An absolute address without blanks, or a mail address."""
    return url.rlike(VALID) | url.rlike("^mailto:.+@.+$")


def is_generic(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(g)) for g in GENERIC)) | (F.octet_length(F.trim(low)) < 5)


def is_navigation(text: Column, url: Column) -> Column:
    """Links that turn pages: by their words, as bare numbers, or by a page in the address."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in TURNING)) | F.trim(text).rlike(r"^\d+$") | F.contains(url, F.lit("pag=")) | F.contains(url, F.lit("page="))


def quality(citations: DataFrame, text: str, source: str, *by: str) -> DataFrame:
    """(by, citations, links, cross_domain, navigation, malformed, relevant, score) of the links of citations; the score is the percentage of relevant ones.

    Groups without a link have score 0; null texts have no links.
    """
    rows = citations.select(*by, host(F.col(source)).alias("_own"), F.explode_outer(_links(F.col(text))).alias("_x"))
    at, url, label = host(F.col("_x.url")), F.col("_x.url"), F.col("_x.text")
    flags = {
        "links": url.isNotNull(), "cross_domain": at != F.col("_own"), "navigation": is_navigation(label, url), "malformed": ~is_valid(url) | F.contains(url, F.lit(" ")),
        "relevant": ~is_generic(label) & is_valid(url),
    }
    sums = rows.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in flags.items()))
    score = F.round(F.when(F.col("links") > 0, F.col("relevant") / F.col("links") * 100).otherwise(0.0), 1)
    return citations.groupBy(*by).agg(F.count("*").alias("citations")).join(sums, list(by)).withColumn("score", score)


def issues(text: Column, source: Column) -> Column:
    """What is wrong with a text's links, distinct and in order: no_source, cross_domain, unrelated, malformed, truncated."""
    own, low = host(source), F.lower(text)
    known = lambda c: reduce(lambda a, b: a | b, (F.contains(c, F.lit(k)) for k in RELEVANT))
    tests = {
        "cross_domain": lambda x: F.coalesce(host(x["url"]) != own, F.lit(False)),
        "unrelated": lambda x: ~known(F.lower(x["text"])) & ~known(low) & (F.octet_length(x["text"]) > 5),
        "malformed": lambda x: ~is_valid(x["url"]),
        "truncated": lambda x: F.contains(x["url"], F.lit("...")) | x["url"].endswith("."),
    }
    found = [F.when(F.exists(_links(text), t), F.lit(n)) for n, t in tests.items()]
    missing = F.when(F.coalesce(source, F.lit("")) == "", F.lit("no_source"))
    return F.array_compact(F.array(missing, *found))


def expanded_name(name: Column, synonyms: dict[str, str]) -> Column:
    """A name, then the words of the first synonym list whose term it holds (longest term first) that aren't there yet, then the list as a whole if it has several words.

    Case is folded when terms are looked for and words compared; the list's own
    order stays. Without a hit, or with an empty list, the name stays as it is.
    """
    low, out = F.lower(name), name
    for term, listed in reversed(sorted(synonyms.items(), key=lambda kv: -len(kv[0].encode()))):
        words: dict[str, str] = {}
        for w in listed.replace(",", " ").split():
            words.setdefault(w.lower(), w)
        added = [F.when(low != w, F.lit(own)) for w, own in words.items()]
        if " " in listed and listed.lower() not in words:
            added.append(F.when(low != listed.lower(), F.lit(listed)))
        out = F.when(F.contains(low, F.lit(term.lower())), F.concat_ws(" ", name, *added)).otherwise(out)
    return out
