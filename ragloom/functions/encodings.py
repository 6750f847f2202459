"""Charsets of fetched bytes, text that was decoded wrongly, and characters that scanners confuse."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import slices

# They must equal those of existing deployments.
#: Bytes of windows-1252 that pages declared as ISO-8859-1 really use.
TELLING = "\x85\x91\x92\x93\x94\x96\x97"
QUOTES = {"’": "'", "‘": "'", "“": '"', "”": '"', "‚": "'", "„": '"', "…": "...", "–": "-", "—": "--"}
#: What text recognition confuses, longest first.
CONFUSED = {"u!lizzare": "utilizzare", "bo%glie": "bottiglie", "sacche$o": "sacchetto", "plas!ca": "plastica", "riﬁu!": "rifiuti", "pia%": "piatti", "!": "t", "�": ""}

#: The characters of windows-1252 from 0x80 to 0x9F; five bytes have none and stay control characters.
_HIGH = "".join(bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(0x80, 0xA0))
_CONTROL = "".join(map(chr, range(0x80, 0xA0)))
_FROM_1252 = str.maketrans(_CONTROL, _HIGH)
_TO_BYTE = {c: chr(b) for b, c in enumerate(_HIGH, 0x80)}
#: Runs that may be the bytes of UTF-8 one by one: characters that stand for a byte from 0x80 on.
_RUN = re.compile("[\x80-\xff" + re.escape("".join(c for c in _HIGH if ord(c) > 0xFF)) + "]{2,}")

SAME = {"utf8": "utf-8", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "iso8859-1": "iso-8859-1", "cp1252": "windows-1252", "ascii": "us-ascii"}
KNOWN = ("utf-8", "us-ascii", "iso-8859-1", "windows-1252", "utf-16", "utf-16le", "utf-16be", "utf-32")


def _bytes_as_text(content: Column) -> Column:
    """One character for each byte."""
    return F.decode(content, "ISO-8859-1")


def _known(name: Column) -> Column:
    """A charset's own name by any of its names; null if it isn't known."""
    names = {**{k: k for k in KNOWN}, **SAME}
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_replace(F.trim(name), "[\"']", "")))


def charset(content: Column, content_type: Column) -> Column:
    """The charset of fetched bytes: by header, else by meta tag, else UTF-8 if they are valid, else ISO-8859-1.

    Names that aren't known count as missing. ISO-8859-1 with bytes that only
    windows-1252 has a character for is windows-1252. Null bytes give null.
    """
    raw = _bytes_as_text(content)
    header = _known(F.regexp_extract(content_type, r"(?i)charset=([^;\s]+)", 1))
    meta = _known(F.regexp_extract(raw, r"""(?i)<meta[^>]+charset\s*=\s*["']?([^"'>\s]+)""", 1))
    found = F.coalesce(header, meta, F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("iso-8859-1"))
    found = F.when((found == "iso-8859-1") & raw.rlike(f"[{TELLING}]"), "windows-1252").otherwise(found)
    return F.when(content.isNotNull(), found)


def decode(content: bytes | None, name: str | None) -> str | None:
    """Bytes as text by the name of a charset; what is no character becomes U+FFFD. Null stays null."""
    if content is None:
        return None
    if name == "windows-1252":
        return content.decode("latin-1").translate(_FROM_1252)
    return content.decode(name or "utf-8", "replace")


def plain_quotes(text: Column) -> Column:
    """Curly quotes, dashes and the ellipsis in ASCII."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), QUOTES.items(), text)


def fetched_text(content: Column, content_type: Column) -> Column:
    """Fetched bytes as text: by charset, with double decoding undone, and quotes in ASCII."""
    return plain_quotes(_fetched(content, charset(content, content_type)))


def unconfused(text: Column) -> Column:
    """Recognised text with the usual confusions mended; characters that stand for unreadable bytes go."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CONFUSED.items(), F.make_valid_utf8(text))


def repair(text: str | None, most: int = 3) -> str | None:
    """Text whose UTF-8 bytes were read as windows-1252 or ISO-8859-1, up to ``most`` times over, as it was.

    Only runs change whose characters stand for bytes that are valid UTF-8 in
    whole: then reading them wrongly again gives the run back, so nothing else
    is touched. Null stays null.
    """

    def once(m: re.Match) -> str:
        try:
            return "".join(_TO_BYTE.get(c, c) for c in m[0]).encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    for _ in range(most if text else 0):
        better = _RUN.sub(once, text)
        if better == text:
            break
        text = better
    return text


@F.arrow_udf(T.StringType())
def _repaired(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in slices(pa.RecordBatch.from_arrays([c], ["text"]) for c in columns):
        yield pa.array([repair(t) for t in batch.column(0).to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _fetched(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in slices(pa.RecordBatch.from_arrays(list(c), ["content", "name"]) for c in columns):
        yield pa.array([repair(decode(c, n)) for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.string())


def repaired(text: Column) -> Column:
    """``repair`` for a column."""
    return _repaired(text)


def misread(text: Column, as_1252: bool = True) -> Column:
    """The UTF-8 bytes of a text, read as windows-1252 or ISO-8859-1: what ``repaired`` undoes."""
    latin = _bytes_as_text(F.encode(text, "UTF-8"))
    return F.translate(latin, _CONTROL, _HIGH) if as_1252 else latin
