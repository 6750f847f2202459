"""Opening hours and addresses in one text: what stands where, and whether it can be meant.

Row functions behind ``operators.proximity``. Positions count code points.
"""

from __future__ import annotations

import re
from itertools import combinations

# They must equal those of existing deployments.
_T = r"(\d{1,2}[:.]?\d{2})"
_H = r"(\d{1,2}(?:[:.]?\d{2})?)"
_DASH = r"\s*[-–—]\s*"
_FROM = r"\b(?:dalle?\s+)?(?:ore\s+)?"
DAYS = "lunedì|martedì|mercoledì|giovedì|venerdì|sabato|domenica|lun|mar|mer|gio|ven|sab|dom"
LONG_DAYS = "lunedì|martedì|mercoledì|giovedì|venerdì|sabato|domenica"
_SCHEDULES = {
    "range": rf"{_FROM}{_T}{_DASH}{_T}\b",
    "from_to": rf"{_FROM}{_T}\s+(?:alle?\s+){_T}\b",
    "hours": rf"{_FROM}(\d{{1,2}}){_DASH}(\d{{1,2}})\b(?!\d)",
    "hours_from_to": rf"{_FROM}(\d{{1,2}})\s+(?:alle?\s+)(\d{{1,2}})\b(?!\d)",
    "day": rf"\b({DAYS})\s*:?\s*(\d{{1,2}}(?:[:.]?\d{{2}})?(?:{_DASH}\d{{1,2}}(?:[:.]?\d{{2}})?)?)\b",
    "opening": rf"\b(?:aperto|apertura|chiusura|orario)\s+(?:dalle?\s+)?(?:ore\s+)?{_H}\s*(?:[-–—]|alle?\s+)?\s*{_H}\b",
    "single": r"\b(?:ore|orario|apertura|chiusura|dalle?|fino)\s+(\d{1,2}[:.]?\d{2})\b",
    "two_ranges": rf"\b{_T}{_DASH}{_T}\s*(?:e|,)\s*{_T}{_DASH}{_T}\b",
}
SCHEDULES = [re.compile(p, re.I) for p in _SCHEDULES.values()]
#: Without hours from one word to another: what free text is searched for when no context is found.
PLAIN_SCHEDULES = [re.compile(p, re.I) for k, p in _SCHEDULES.items() if k != "hours_from_to"]
MONTHS = "gennaio|febbraio|marzo|aprile|maggio|giugno|luglio|agosto|settembre|ottobre|novembre|dicembre|gen|feb|mar|apr|mag|giu|lug|ago|set|ott|nov|dic"
HINTS = (
    "orario orari apertura chiusura aperto chiuso ore dalle alle fino mattina pomeriggio sera lunedì martedì mercoledì giovedì venerdì sabato domenica "
    "lun mar mer gio ven sab dom ricevimento sportello ufficio servizio"
).split()
_TYPES = r"(?:via|viale|piazza|p\.?zza|corso|largo|vicolo|piazzale|strada|str\.)"
ADDRESS = re.compile(rf"\b{_TYPES}\s+[A-Za-zÀ-ÖØ-öø-ÿ'\-\s]{{2,60}}(?:,?\s+(?:\d{{1,4}}[A-Za-z]?))?(?:.*?(?:\b\d{{5}}\b))?", re.I)
CELL_ADDRESS = re.compile(r"""\b(?:via|viale|piazza|p\.?:?zza|corso|largo|vicolo|piazzale|strada|str\.)\s+[A-Za-zÀ-ÖØ-öø-ÿ'"\-\s]{2,60}(?:,?\s+\d{1,4}[A-Za-z]?)?""", re.I)
PLACE_WORDS = ("indirizzo", "ubicazione", "sede", "presso")
GENERIC = ("ufficio", "uffici", "sportello", "sportelli", "servizio", "servizi", "office", "service")
GENERIC_PLACES = ("ufficio", "uffici", "sportello", "sportelli", "servizio", "servizi", "municipio", "comune", "ente", "office", "service", "ordinanze")
APPOINTMENT = re.compile(r"appuntamento|prenotazione|riceve\s+per|su\s+appuntamento|previo\s+appuntamento|solo\s+appuntamento", re.I)
ENTITIES = {
    "comando_polizia": r"\b(?:COMANDO\s+)?POLIZIA\s+LOCALE\b",
    "vigili_urbani": r"\bVIGILI\s+URBANI\b",
    "polizia_municipale": r"\bPOLIZIA\s+MUNICIPALE\b",
    "ufficio_tecnico": r"\bUFFICIO\s+TECNICO\b",
    "anagrafe": r"\bUFFICIO\s+(?:SERVIZI\s+)?(?:DEMOGRAFICI|ANAGRAFE)\b",
}

_YEAR = re.compile(r"\b(19|20)\d{2}\b")
_DATE = re.compile(r"\b\d{1,2}[/\-.]\d{1,2}[/\-.](?:19|20)?\d{2}\b")
_MONTH = re.compile(rf"\b(?:{MONTHS})\b", re.I)
_OTHER = re.compile(r"\b(?:tel|telefono|cod|codice|€|euro|prezzo|costo|partita\s+iva|p\.iva|cf|c\.f\.)\b", re.I)
_STREET = re.compile(r"\b(?:via|viale|corso|piazza|largo|lat|lon|coordinate)\b", re.I)
_TIME = re.compile(r"\b(\d{1,2})(?:[:.](\d{2}))?\b")
_NIGHT = re.compile(r"\b(?:notturno|24|continuo|emergenza)\b", re.I)
_HINT = re.compile(rf"\b(?:{'|'.join(HINTS)})\b", re.I)
_SPACES = re.compile(r"\s+")
_TAG = re.compile(r"<[^>]*>")
_DAY_CELL = re.compile(rf"(?:\*{{0,2}})?({DAYS})(?:\*{{0,2}})?", re.I)
_RANGE = re.compile(rf"{_T}{_DASH}{_T}")
_ONE = re.compile(r"\d{1,2}[:.]?\d{2}")
_RECEIVES = re.compile(r"[^.\n]{0,80}(?:riceve|solo|previo|su)[^.\n]{0,80}appuntamento[^.\n]*", re.I)
_BOOKING = re.compile(r"[^.\n]{0,80}prenotazione[^.\n]{0,80}", re.I)
_CONTEXT_RANGES = [re.compile(p, re.I) for p in (rf"\b{_T}{_DASH}{_T}\b", rf"\|\s*(?:martedì|giovedì|venerdì)\s*\|\s*{_T}{_DASH}{_T}\s*\|", rf"(?:martedì|giovedì|venerdì)\s+{_T}{_DASH}{_T}")]

Found = list[tuple[str, int]]


def one_line(text: str) -> str:
    return _SPACES.sub(" ", text.strip())


def valid_schedule(schedule: str, text: str, at: int) -> bool:
    """Whether hours found at a place can be opening hours: no dates, streets or odd hours around, and a word of time nearby."""
    schedule = one_line(schedule)
    around = f"{text[max(0, at - 50) : max(0, at - 50) + 50]} {schedule} {text[at + len(schedule) : at + len(schedule) + 50]}"
    if _YEAR.search(schedule) or _DATE.search(around) or _MONTH.search(around) or _OTHER.search(schedule) or _STREET.search(around):
        return False
    for hour, minute in _TIME.findall(schedule):
        if int(hour) > 23 or int(minute or 0) > 59 or (int(hour) < 6 and not _NIGHT.search(around)):
            return False
    return bool(_HINT.search(around))


def _rows(text: str):
    """Lines that are rows of a pipe table, with their place: cells without blanks and rules."""
    at = 0
    for line in text.split("\n"):
        line_at, at = at, at + len(line) + 1
        if line.count("|") >= 2:
            cells = (one_line(_TAG.sub("", c)) for c in line.rstrip("\r").split("|"))
            yield line_at, [c for c in cells if c not in ("", "---")]


def table_schedules(text: str) -> Found:
    """Rows of pipe tables that begin with a weekday: the day and its hours."""
    out = []
    for at, cells in _rows(text):
        day = _DAY_CELL.fullmatch(cells[0]) if len(cells) > 1 else None
        times: list[str] = []
        for cell in cells[1:] if day else ():
            if "chiuso" in cell.lower():
                times.append("Chiuso")
            elif found := _RANGE.findall(cell):
                times += [f"{a}-{b}" for a, b in found]
            elif found := _ONE.findall(cell):
                times.append("-".join(found) if len(found) == 2 else " ".join(found))
        if times:
            out.append((f"{day[1][:1].upper()}{day[1][1:]}: {'; '.join(dict.fromkeys(times))}", at))
    return out


def table_addresses(text: str) -> Found:
    """Cells of pipe tables with a street, else with a word of places."""
    out = []
    for at, cells in _rows(text):
        for cell in cells:
            found = [m[0] for m in CELL_ADDRESS.finditer(cell)]
            for value in found or ([cell] if any(w in cell.lower() for w in PLACE_WORDS) else []):
                place = text.lower().find(value.lower(), at)
                out.append((one_line(value), place if place >= 0 else at))
    return out


def _distinct(found: Found) -> Found:
    """The first of equal values."""
    out: dict[str, int] = {}
    for value, at in found:
        if value:
            out.setdefault(value, at)
    return list(out.items())


def schedules(text: str) -> Found:
    """All hours of a text that can be meant, by pattern and place, then rows of tables; each value once."""
    free = [(m[0].strip(), m.start()) for p in SCHEDULES for m in p.finditer(text) if valid_schedule(m[0], text, m.start())]
    return _distinct(free + table_schedules(text))


def addresses(text: str) -> Found:
    """All addresses of a text, then cells of tables; each value once."""
    return _distinct([(one_line(m[0]), m.start()) for m in ADDRESS.finditer(text)] + table_addresses(text))


def appointment(text: str, terms: list[str]) -> str | None:
    """The first line that names a term (of three letters, not generic) and speaks of appointments."""
    wanted = [t for t in terms if len(t) >= 3 and t not in GENERIC]
    for line in text.split("\n"):
        plain = _TAG.sub("", line).strip()
        if plain and (not terms or any(t in plain.lower() for t in wanted)) and APPOINTMENT.search(plain):
            return one_line(plain)
    return None


def label(text: str, terms: list[str]) -> str | None:
    """The first line that holds a term."""
    for line in text.split("\n"):
        plain = _TAG.sub("", line).strip()
        if plain and any(t and t in plain.lower() for t in terms):
            return one_line(plain)
    return None


def positions(low: str, terms: list[str], generic: tuple[str, ...]) -> list[int]:
    """Where terms of three letters that aren't generic start, in order; a term doesn't overlap itself."""
    out = set()
    for t in terms:
        if len(t) >= 3 and t not in generic:
            at = low.find(t)
            while at >= 0:
                out.add(at)
                at = low.find(t, at + len(t))
    return sorted(out)


def name_position(low: str, name: str, generic: tuple[str, ...]) -> int | None:
    """Where a name stands: in whole, else amid the first two of its words that both stand, else its first word that does."""
    if (at := low.find(name)) >= 0:
        return at
    words = [w for w in name.split() if w not in generic]
    for a, b in combinations(words, 2):
        x, y = low.find(a), low.find(b)
        if x >= 0 and y >= 0:
            return (x + y) // 2
    return next((p for w in words if (p := low.find(w)) >= 0), None)


def contexts(text: str) -> list[tuple[str, str, int]]:
    """(kind, words, place) of the first mention of each known office."""
    found = ((kind, re.compile(p, re.I).search(text)) for kind, p in ENTITIES.items())
    return [(kind, m[0], m.start()) for kind, m in found if m]


def valid_range(start: str, end: str) -> bool:
    a, b = (int(re.split("[:.]", x)[0]) for x in (start, end))
    return 7 <= a <= 20 and 7 <= b <= 20 and a < b


def _holds(text: str, terms: list[str]) -> bool:
    low = text.lower()
    return any(len(t) >= 3 and t.lower() not in ("ufficio", "uffici", "servizio", "servizi", "comune", "municipio") and t.lower() in low for t in terms)


def from_context(text: str, entity: str, at: int, terms: list[str]) -> tuple[list[str], list[str], str | None, str | None]:
    """Hours, weekdays, mail and phone in the 400 characters from an office's mention.

    With terms, hours count near one of them (or if the office's name holds
    one). Without hours a line about appointments or bookings stands in.
    """
    window = text[at : at + 400]
    mail = re.search(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", window)
    phone = re.search(r"\b(?:tel[:.]?\s*)?(?:\+39\s*)?(?:0\d{1,3}[.\s]?\d{6,8}|3\d{2}[.\s]?\d{3}[.\s]?\d{3,4})\b", window)
    days = list(dict.fromkeys(d.lower() for d in re.findall(rf"\b({LONG_DAYS})\b", window, re.I)))
    found = table_schedules(window) + [(f"{m[1]}-{m[2]}", m.start()) for p in _CONTEXT_RANGES for m in p.finditer(window) if valid_range(m[1], m[2])]
    near = lambda place: not terms or _holds(window[max(0, place - 120) : max(0, place - 120) + 240], terms) or _holds(entity, terms)
    hours = [v for v, place in found if near(place)]
    for pattern in (_RECEIVES, _BOOKING):
        if not hours and (m := pattern.search(window)) and near(m.start()):
            hours = [one_line(m[0])]
    if not hours and "riceve per appuntamento" in window.lower():
        hours = ["Riceve per appuntamento"]
    return hours, days, mail and mail[0], phone and phone[0].strip()


def inferred(days: list[str]) -> list[str]:
    """Likely hours of an office that names three days at most."""
    each = {"martedì": "Martedì e Venerdì: 9:00-12:00 (orario inferito)", "venerdì": "Martedì e Venerdì: 9:00-12:00 (orario inferito)", "giovedì": "Giovedì: 15:00-17:00 (orario inferito)"}
    out = [each[d] for d in days if d in each] if len(days) <= 3 else []
    return list(dict.fromkeys(out + (["Apertura: Martedì e Venerdì mattina, Giovedì pomeriggio"] if {"martedì", "venerdì"} <= set(days) else [])))


def office_hours(text: str, terms: list[str] = []) -> list[str]:
    """Hours of the offices that a text names (with terms: of those whose name holds one); without any, all hours of the text."""
    out: list[str] = []
    for _, entity, at in contexts(text):
        if not terms or _holds(entity, terms):
            hours, days, _, _ = from_context(text, entity, at, terms)
            out += hours or (inferred(days) if days else [])
    return list(dict.fromkeys(out)) or list(dict.fromkeys(m[0].strip() for p in PLAIN_SCHEDULES for m in p.finditer(text) if valid_schedule(m[0], text, m.start())))


_LINES = [re.compile(p, re.I) for p in (rf"(?:{LONG_DAYS}).*?(?:\d{{1,2}}[:.]?\d{{0,2}}.*?\d{{1,2}}[:.]?\d{{0,2}})", rf"(?:dalle?\s+)?(?:ore\s+)?{_T}{_DASH}{_T}", r"(?:aperto|chiuso).*?(?:\d{1,2}[:.]?\d{0,2})", r"(?:orario|orari).*?(?:\d{1,2}[:.]?\d{0,2}.*?\d{1,2}[:.]?\d{0,2})")]


def canonical(lines: list[str]) -> list[str]:
    """Lines with hours in one form, each once whatever its case; other lines go."""
    out: dict[str, str] = {}
    for line in lines:
        m = next((m for p in _LINES if (m := p.search(line))), None)
        if m:
            value = re.sub(r"\s*-\s*", " - ", re.sub(r"\s*:\s*", ": ", re.sub(r"\s{2,}", " ", m[0].strip())))
            value = re.sub(r"\s{2,}", " ", re.sub(r"\bmartedì\b", "martedì", value, flags=re.I)).strip()
            out.setdefault(value.lower(), value)
    return list(out.values())
