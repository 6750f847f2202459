"""Personal data: patterns propose spans, checksums confirm them, context words score them.

DataFrame expressions only. Positions come from the pieces between matches:
a match starts after all pieces and matches before it, in code points. The
patterns never retry inside a run that already failed, so every scan is linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = "[0-9]"


@dataclass(frozen=True)
class Kind:
    """A kind of span: when to look, what to look for, what must hold, how sure it is.

    ``guard`` and ``check`` are SQL conditions on ``text`` and on the match
    ``m``; ``context`` is a pattern that, found shortly before or after the
    match, adds 0.3 to the ``prior``.
    """

    name: str
    guard: str
    pattern: str
    check: str
    prior: float
    context: str


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: From the right, every second digit counts double, less 9 above 9.
_LUHN = (
    f"aggregate(transform(sequence(1, length({_DIGITS})), i -> int(substring({_DIGITS}, -i, 1)) * if(i % 2 = 0, 2, 1)), "
    "0, (a, x) -> a + x - if(x > 9, 9, 0)) % 10 = 0"
)
#: Four characters go to the end, letters count from 10 on, the remainder by 97 is 1.
_MOVED = "concat(substring(replace(m, ' ', ''), 5), substring(replace(m, ' ', ''), 1, 4))"
_MOD97 = (
    f"aggregate(transform(sequence(1, length({_MOVED})), i -> substring({_MOVED}, i, 1)), 0, "
    "(a, c) -> if(c <= '9', a * 10 + ascii(c) - 48, a * 100 + ascii(c) - 55) % 97) = 1"
)

#: The four base kinds first; a base span is kept whatever its score.
BASE = ("email", "ip", "card", "phone")
KINDS = (
    Kind("email", "contains(text, '@')", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.9, "mail|contact|write"),
    Kind("ip", "contains(text, '.')", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", r"forall(split(m, '\\.'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', ltrim('0', p))) <= 255)", 0.6, "ip|host|server|address"),
    Kind("card", "true", r"[0-9](?<!(?:[0-9]|[0-9][\x20-])[0-9])(?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", _LUHN, 0.8, "card|visa|credit|payment"),
    Kind("phone", "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) between 10 and 15", 0.7, "phone|tel|call|fax|mobile"),
    Kind("iban", "true", r"[A-Z]{2}(?<![A-Za-z0-9][A-Z]{2})[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+", _MOD97, 0.9, "iban|account|bank"),
    Kind("key", "contains(text, 'AKIA')", r"AKIA[0-9A-Z]{16}", "true", 0.8, "key|access|secret"),
    Kind("secret", "text rlike '(?i)password|passwd|secret|token|api_key'", r"(?i)(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?\"?[a-z0-9/+_-]{8,}+", "true", 0.7, "login|user|auth"),
    Kind("ssn", "contains(text, '-')", r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", "true", 0.3, "ssn|social security|tax"),
)
THRESHOLD = 0.5
AROUND = 40


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(k: Kind) -> Column:
    """All matches of a kind in ``text``."""
    return F.expr(f"if({k.guard}, regexp_extract_all(text, {_sql(k.pattern)}, 0), cast(array() as array<string>))")


def _gaps(k: Kind) -> Column:
    """What stands before each match, and after the last; nothing without a match."""
    return F.expr(f"if(size(_m_{k.name}) > 0, split(text, {_sql(k.pattern)}, -1), cast(array() as array<string>))")


def _starts(k: Kind) -> Column:
    """Where each match starts, in one pass: after all gaps and matches before it, and its own gap."""
    sizes = f"zip_with(_m_{k.name}, _g_{k.name}, (m, g) -> named_struct('gap', bigint(length(g)), 'size', bigint(coalesce(length(m), 0))))"
    zero = "named_struct('at', 0L, 'starts', cast(array() as array<bigint>))"
    return F.expr(f"aggregate({sizes}, {zero}, (a, x) -> named_struct('at', a.at + x.gap + x.size, 'starts', array_append(a.starts, a.at + x.gap)), a -> a.starts)")


def _spans(k: Kind, order: int) -> Column:
    """All confirmed spans of a kind: start, ord, kind, end, score."""
    near = f"substring(text, greatest(1, int(x.start) + 1 - {AROUND}), int(least(x.start, {AROUND}))) || ' ' || substring(text, int(x.start) + 1 + length(x.m), {AROUND})"
    sure = f"exists(array(_m_{k.name}[i]), m -> {k.check})"
    found = (
        f"transform(filter(transform(_m_{k.name}, (m, i) -> i), i -> {sure}), "
        f"i -> named_struct('m', _m_{k.name}[i], 'start', _s_{k.name}[i]))"
    )
    scored = (
        f"transform({found}, x -> named_struct('start', x.start, 'ord', {order}, 'kind', '{k.name}', 'end', x.start + length(x.m), "
        f"'score', {k.prior}D + if(lower({near}) rlike '{k.context}', 0.3D, 0D)))"
    )
    return F.expr(scored if k.name in BASE else f"filter({scored}, x -> x.score >= {THRESHOLD}D)")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, spans) of every row; null texts count as empty.

    ``spans`` is sorted by start, then kind as listed in KINDS: structs of
    start, ord, kind, end (code points, end exclusive) and score. Base kinds
    follow their patterns and checks alone; the added kinds also need a score
    of THRESHOLD. Rows repeat as they repeat; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = rows.select(id_col, "text", *(_matches(k).alias(f"_m_{k.name}") for k in KINDS))
    each = each.select("*", *(_gaps(k).alias(f"_g_{k.name}") for k in KINDS))
    each = each.select("*", *(_starts(k).alias(f"_s_{k.name}") for k in KINDS))
    each = each.select(id_col, "text", *(_spans(k, i).alias(f"_{k.name}") for i, k in enumerate(KINDS)))
    return each.select(id_col, "text", F.sort_array(F.concat(*(f"_{k.name}" for k in KINDS))).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets.

    Overlapping spans are one replacement, named by the first. Texts without
    spans, nulls among them, stay as they are, and so do the other columns;
    ``size_col`` is the new length where the text changed.
    """
    if size_col not in docs.columns:
        raise ValueError(f"no column {size_col!r}")
    keep = docs.columns
    whole = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row")
    rows = docs.select(whole, F.col(text_col).alias("_text"))
    found = find(rows, id_col="_row", text_col="_text")
    # the text after the last span, and what stands before it, piece by piece
    done = F.expr(
        "aggregate(spans, named_struct('at', 0L, 'out', ''), (a, s) -> if(s.start < a.at, named_struct('at', greatest(a.at, s.end), 'out', a.out), "
        "named_struct('at', s.end, 'out', a.out || substring(text, int(a.at) + 1, int(s.start - a.at)) || '<' || upper(s.kind) || '>')), "
        "a -> a.out || substring(text, int(a.at) + 1))"
    )
    found = found.withColumn("_new", F.when(F.size("spans") > 0, done))
    cols = []
    for c in keep:
        old = F.col("_row").getField(c)
        if c == text_col:
            old = F.coalesce("_new", old)
        elif c == size_col:
            old = F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        cols.append(old.alias(c))
    return found.select(*cols)


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans."""
    label = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select(
        id_col,
        *counts,
        F.sha2(F.concat_ws(",", F.transform(base, label)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", label)).alias("spans"),
    )


def _duck(k: Kind, order: int, pattern: str, check: str) -> str:
    near = f"substring(text, greatest(1, s + 1 - {AROUND}), least(s, {AROUND})) || ' ' || substring(text, s + 1 + length(m), {AROUND})"
    keep = "true" if k.name in BASE else f"{k.prior} + (CASE WHEN regexp_matches(lower({near}), '{k.context}') THEN 0.3 ELSE 0 END) >= {THRESHOLD}"
    return f"""SELECT doc_id, s, {order} AS o, '{k.name}:' || s || ':' || (s + length(m)) AS l FROM (
      SELECT doc_id, text, ms[i] AS m, list_sum(list_transform(gs[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[:i-1], lambda g: length(g))), 0) AS s0, CAST(s0 AS BIGINT) AS s FROM (
        SELECT doc_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT doc_id, text, regexp_extract_all(text, {pattern}) AS ms, string_split_regex(text, {pattern}) AS gs FROM d WHERE regexp_matches(text, {pattern})))
      ) WHERE ({check}) AND ({keep})"""


def _oracle() -> str:
    luhn = """len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(range(0, len(regexp_replace(m, '[^0-9]', '', 'g'))), lambda i:
      CASE WHEN i % 2 = 1 THEN substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i + 1, 1)::INT * 2 - CASE WHEN substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i + 1, 1)::INT > 4 THEN 9 ELSE 0 END
      ELSE substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i + 1, 1)::INT END)) % 10 = 0"""
    mod97 = """list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c:
      (CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT), lambda a, c: CASE WHEN c < 10 THEN a * 10 + c ELSE a * 100 + c END % 97, 0::BIGINT) = 1"""
    plain = {
        "email": (r"'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'", "true"),
        "ip": (r"'[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
        "card": (r"'[0-9](?:[\x20-]?[0-9])+'", luhn),
        "phone": (r"'\+[0-9][\x20().0-9-]+[0-9]'", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"),
        "iban": (r"'[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}'", f"NOT regexp_matches(substr(text, greatest(s, 1), CASE WHEN s > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9]') AND {mod97}"),
        "key": (r"'AKIA[0-9A-Z]{16}'", "true"),
        "secret": (r"""'(?i)(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?"?[a-z0-9/+_-]{8,}'""", "true"),
        "ssn": (r"'[0-9]{3}-[0-9]{2}-[0-9]{4}'", "NOT regexp_matches(substr(text, greatest(s, 1), CASE WHEN s > 0 THEN 1 ELSE 0 END) || '|' || substr(text, s + length(m) + 1, 1), '[0-9-]')"),
    }
    parts = " UNION ALL ".join(_duck(k, i, *plain[k.name]) for i, k in enumerate(KINDS))
    counts = ", ".join(f"count(*) FILTER (WHERE o = {i}) AS n_{k}" for i, k in enumerate(BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS ({parts}),
    g AS (SELECT doc_id, {counts}, string_agg(l, ',' ORDER BY s, o) FILTER (WHERE o < {len(BASE)}) AS base, string_agg(l, ',' ORDER BY s, o) AS spans FROM f GROUP BY 1)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = _oracle()
