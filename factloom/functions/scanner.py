"""Typed value candidates in plain text (K1 to K22). Offsets are code points; every candidate is exactly its slice of the text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from datetime import date
from itertools import accumulate
from typing import NamedTuple

from factloom.functions.scalars import IBAN_LENGTHS

# Month names, currency signs and words that announce identifiers.
MONTHS = {m: i for i, names in enumerate(("january januar jan janvier enero", "february februar feb février febrero", "march märz mar mars marzo", "april apr avril abril", "may mai mayo", "june juni jun juin junio", "july juli jul juillet julio", "august aug août agosto", "september sep sept septembre septiembre", "october oktober oct okt octobre octubre", "november nov novembre noviembre", "december dezember dec dez décembre diciembre"), 1) for m in names.split()}
CURRENCY = r"(?:€|EUR|Euro|\$|USD|US\$|£|GBP|CHF|Fr\.|PLN|zł|CZK|Kč|SEK|DEM|DM)"
LABELS = r"(?:nummer|number|no\.|nr\.?|n°|n\.º|numéro|número|referenz|reference|référence|referencia|kennzeichen|aktenzeichen|id)"
LEGAL = r"(?:GmbH(?: & Co\. KG)?|AG|KG|eG|SE|OHG|UG|Ltd\.?|Inc\.?|S\.A\.|e\.V\.)"
STREETS = r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|kamp|wall|zeile|stieg|ufer|bühl)"
#: Kinds from most to least specific; a generic candidate that overlaps a specific one is dropped, and at most MOST stay.
ORDER = ("mrz", "iban", "bic", "tax_id", "vin", "email", "phone", "date", "period", "money", "amount", "plate", "identifier", "person", "organization", "address", "cell")
GENERIC = frozenset(("amount", "identifier", "phone", "cell", "plate"))
MOST = 200


class Candidate(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int
    value: str
    label: str | None
    checksum: bool | None


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_BIC = re.compile(r"(?<![A-Z0-9])[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![A-Z0-9])")
_TAX = re.compile(r"(?<![\d./-])\d(?:[ /]?\d){10}(?![\d/])")
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![\w-])")
_PHONE = re.compile(r"(?<![\w+.,/-])(?:\+|00|0)[\d](?:[\d ()/-]{5,22})\d(?![\w.,/])")
_ISO = re.compile(r"(?<![\d.-])(\d{4})-(\d{2})-(\d{2})(?![\d-])")
_DMY = re.compile(r"(?<![\d./])(\d{1,2})([./])(\d{1,2})\2(\d{4})(?!\d)")
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_DAY_MONTH = re.compile(rf"(?<![\w.])(\d{{1,2}})\.? (?:de )?({_MONTH})\.?,? (?:de )?(\d{{4}})(?!\d)", re.I)
_MONTH_DAY = re.compile(rf"(?<!\w)({_MONTH})\.? (\d{{1,2}}), (\d{{4}})(?!\d)", re.I)
_MONTH_YEAR = re.compile(rf"(?<![\w.])(?<!\d )({_MONTH})\.? (?:de )?(\d{{4}})(?!\d)", re.I)
_YEAR_MONTH = re.compile(r"(?<![\d./-])(?:(\d{4})-(\d{2})|(\d{2})/(\d{4}))(?![\d./-])")
_YEAR = re.compile(r"(?:Kalenderjahr|Veranlagungszeitraum|Jahr|calendar year|assessment period|year|année|ejercicio|año) (\d{4})(?!\d)", re.I)
_NUMBER = r"[-+−]?\d{1,3}(?:[.,'  ]?\d{3})*(?:[.,](?:\d{2}|-))?(?!\d)"
_MONEY = re.compile(rf"(?<![\w.,])(?:({CURRENCY})\s?({_NUMBER})|({_NUMBER})\s?({CURRENCY})(?!\w))")
_AMOUNT = re.compile(r"(?<![\w.,/-])[-+−]?\d{1,3}(?:[.,'  ]?\d{3})*[.,]\d{2}(?![\w%.,/-]|\.\d| ?%)")
_IDENT = re.compile(rf"{LABELS}\s*[:.]?\s*([A-Z0-9][A-Z0-9./-]{{3,24}}\d[A-Z0-9./-]*|[A-Z]{{1,3}}-?\d{{4,}})", re.I)
_PLATE = re.compile(r"(?<![\w-])[A-ZÄÖÜ]{1,3}[- ][A-Z]{1,2} ?\d{1,4}[EH]?(?![\w-])")
_VIN = re.compile(r"(?<![A-Z0-9])(?=(?:[A-Z]*\d){2})(?=\d*[A-Z])[A-HJ-NPR-Z0-9]{17}(?![A-Z0-9])")
_TITLE = re.compile(r"(?:Herrn?|Frau|Mr\.?|Mrs\.?|Ms\.?|Mme|Monsieur|Madame|Señora?|Dr\.)\s+((?:[A-ZÄÖÜÉ][\w’'-]+ ?){1,3})")
_ORG = re.compile(rf"(?<!\w)((?:[A-ZÄÖÜ][\w&.-]* ){{1,6}}{LEGAL})(?!\w)")
_STREET = re.compile(rf"(?<!\w)[A-ZÄÖÜ][\w-]*{STREETS} \d{{1,4}} ?[a-z]?(?!\w)|(?<!\d)\d{{5}} [A-ZÄÖÜ][\w-]+")
_CELL = re.compile(r"^\s*([^:\t]{2,60}?)(?:\s?:\s+|\t|\s{2,})(\S.*?)\s*$")
_MRZ_LINE = re.compile(r"[A-Z0-9<]{30}|[A-Z0-9<]{36}|[A-Z0-9<]{44}")


def check_digit(text: str) -> int:
    """ICAO 9303: weights 7, 3, 1; letters from 10, filler 0."""
    value = lambda c: 0 if c == "<" else int(c) if c.isdigit() else ord(c) - 55
    return sum(value(c) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10


def iban_ok(text: str) -> bool:
    y = re.sub(r"\s", "", text).upper()
    if IBAN_LENGTHS.get(y[:2]) != len(y):
        return False
    return int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1


def tax_ok(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    if len(d) != 11 or d[0] == 0:
        return False
    counts = [d[:10].count(x) for x in range(10)]
    more = [n for n in counts if n > 1]
    if len(more) != 1 or more[0] > 3 or re.search(r"(\d)\1\1", "".join(map(str, d[:10]))):
        return False
    p = 10
    for x in d[:10]:
        s = (x + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == d[10] if 11 - p != 10 else d[10] == 0


def pension_ok(text: str) -> bool:
    """German pension number: area, day (or day + 50), month, year, letter, serial, check digit."""
    m = re.fullmatch(r"(\d{2})(\d{2})(\d{2})(\d{2})([A-Z])(\d{2})(\d)", re.sub(r"\s", "", text))
    if not m or not (1 <= int(m[2]) <= 31 or 51 <= int(m[2]) <= 81) or not 1 <= int(m[3]) <= 12:
        return False
    digits = [*map(int, m[1] + m[2] + m[3] + m[4]), *map(int, f"{ord(m[5]) - 64:02d}"), *map(int, m[6])]
    cross = lambda x: x // 10 + x % 10
    return sum(cross(a * b) for a, b in zip(digits, (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1))) % 10 == int(m[7])


def decimal_text(text: str) -> str | None:
    """Canonical decimal of an amount as written: groups must be even and their mark not the decimal mark."""
    t = re.sub(r"[\s  ']", "", text).replace("−", "-").rstrip("-")
    m = re.fullmatch(r"([-+]?)(\d+(?:[.,]\d{3})*|\d+)(?:([.,])(\d{0,2}))?", t)
    if not m:
        return None
    groups = set(re.findall(r"[.,]", m[2]))
    if len(groups) > 1 or m[3] and m[3] in groups:
        return None
    whole, cents = re.sub(r"[.,]", "", m[2]).lstrip("0") or "0", (m[4] or "").rstrip("0")
    sign = "-" if m[1] == "-" and (whole != "0" or cents) else ""
    return sign + whole + ("." + cents if cents else "")


def _day(y: int, m: int, d: int) -> str | None:
    try:
        return date(y, m, d).isoformat()
    except ValueError:
        return None


def _month(y: int, m: int) -> str | None:
    if not 1 <= m <= 12 or not 1900 <= y <= 2200:
        return None
    last = (date(y + m // 12, m % 12 + 1, 1).toordinal()) - 1
    return f"{y:04d}-{m:02d}-01/{date.fromordinal(last).isoformat()}"


def mrz(lines: list[tuple[int, int, str]]) -> list[Candidate]:
    """Machine-readable zones of three lines of 30, or two of 36 or 44, with number, birth and expiry and their checks."""
    out = []
    rows = [(no, at, t) for no, at, raw in lines if _MRZ_LINE.fullmatch(t := raw.strip())]
    i = 0
    while i < len(rows):
        n = len(rows[i][2])
        need = 3 if n == 30 else 2
        zone = rows[i : i + need]
        if len(zone) < need or any(len(z[2]) != n for z in zone) or zone[0][2][0] not in "PIAVC":
            i += 1
            continue
        if n == 30:
            fields = [(0, 5, 14, 14, "document"), (1, 0, 6, 6, "birth"), (1, 8, 14, 14, "expiry")]
        else:
            fields = [(1, 0, 9, 9, "document"), (1, 13, 19, 19, "birth"), (1, 21, 27, 27, "expiry")]
        oks = []
        for row, a, b, c, what in fields:
            no, at, t = zone[row]
            ok = t[c].isdigit() and check_digit(t[a:b]) == int(t[c])
            oks.append(ok)
            out.append(Candidate("mrz", t[a:b], at + a, at + b, no, t[a:b].rstrip("<"), what, ok))
        no, at, t = zone[0]
        out.append(Candidate("mrz", t, at, at + n, no, "zone", None, all(oks)))
        i += need
    return out


def scan(text: str | None, known: tuple[str, ...] = ()) -> list[Candidate]:
    """All candidates of a text in its order, at most MOST: those with a good checksum, then with a label, then by kind and place."""
    if not text:
        return []
    out: list[Candidate] = []
    lines, at = [], 0
    for no, raw in enumerate(text.split("\n")):
        lines.append((no, at, raw))
        at += len(raw) + 1
    out += mrz([(no, at + len(raw) - len(raw.lstrip()), raw) for no, at, raw in lines])
    prev = ""
    for no, at, raw in lines:
        low = raw.lower()

        def put(kind: str, m: re.Match, value: str | None, group: int = 0, checksum: bool | None = None) -> None:
            if value is not None:
                a, b = m.span(group)
                head = raw[:a].rstrip()
                label = re.sub(r"^.*(?:\t|\s{2,})", "", head[:-1]).strip()[-60:] if head.endswith(":") else prev if not head and 0 < len(prev) <= 40 and prev.endswith(":") else None
                out.append(Candidate(kind, raw[a:b], at + a, at + b, no, value, (label or "").rstrip(":") or None, checksum))  # noqa: B023

        if any(c.isdigit() for c in raw):
            for m in _IBAN.finditer(raw):
                n = IBAN_LENGTHS.get(m.group()[:2], 0)
                squeezed = re.sub(" ", "", m.group())
                if n and len(squeezed) >= n and (cut := re.match(r"(?:\S ?){%d}" % n, m.group())):
                    t = cut.group().rstrip()
                    out.append(Candidate("iban", t, at + m.start(), at + m.start() + len(t), no, squeezed[:n], None, iban_ok(t)))
            for m in _TAX.finditer(raw):
                ok = tax_ok(m.group())
                if ok or "steuer" in low or "tax" in low:
                    put("tax_id", m, re.sub(r"\D", "", m.group()), checksum=ok)
            for m in re.finditer(r"(?<!\w)\d{2} ?\d{6} ?[A-Z] ?\d{3}(?!\w)", raw):
                ok = pension_ok(m.group())
                if ok or "renten" in low or "versicherungsn" in low:
                    put("identifier", m, re.sub(r"\s", "", m.group()), checksum=ok)
            for m in _ISO.finditer(raw):
                put("date", m, _day(int(m[1]), int(m[2]), int(m[3])))
            for m in _DMY.finditer(raw):
                put("date", m, _day(int(m[4]), int(m[3]), int(m[1])))
            for m in _DAY_MONTH.finditer(raw):
                put("date", m, _day(int(m[3]), MONTHS[m[2].lower()], int(m[1])))
            for m in _MONTH_DAY.finditer(raw):
                put("date", m, _day(int(m[3]), MONTHS[m[1].lower()], int(m[2])))
            for m in _MONTH_YEAR.finditer(raw):
                put("period", m, _month(int(m[2]), MONTHS[m[1].lower()]))
            for m in _YEAR_MONTH.finditer(raw):
                put("period", m, _month(int(m[1] or m[4]), int(m[2] or m[3])))
            for m in _YEAR.finditer(raw):
                put("period", m, f"{m[1]}-01-01/{m[1]}-12-31", 1)
            for m in _MONEY.finditer(raw):
                put("money", m, decimal_text(m[2] or m[3]))
            for m in _AMOUNT.finditer(raw):
                put("amount", m, decimal_text(m.group()))
            for m in _IDENT.finditer(raw):
                put("identifier", m, re.sub(r"[^A-Za-z0-9]", "", m[1]).upper(), 1)
            for m in _PHONE.finditer(raw):
                d = re.sub(r"\D", "", m.group())
                if 8 <= len(d) <= 15 and (m.group()[0] == "+" or m.group().startswith("00") or re.search(r"tel|fon|phone|mobil|fax", low) or re.match(r"01[567]", d)):
                    put("phone", m, ("+" if m.group()[0] == "+" else "") + d)
            for m in _PLATE.finditer(raw):
                put("plate", m, re.sub(r"[ -]", "", m.group()))
            if re.search(r"vin|fahrgestell|fahrzeug-ident|chassis", low):
                for m in _VIN.finditer(raw):
                    put("vin", m, m.group())
            for m in _STREET.finditer(raw):
                put("address", m, m.group())
        if re.search(r"bic|swift", low):
            for m in _BIC.finditer(raw):
                put("bic", m, m.group())
        if "@" in raw:
            for m in _EMAIL.finditer(raw):
                if ".." not in m.group():
                    put("email", m, m.group().lower())
        for m in _TITLE.finditer(raw):
            a, b = m.start(1), m.start(1) + len(m[1].rstrip())
            out.append(Candidate("person", raw[a:b], at + a, at + b, no, raw[a:b], None, None))
        for name in known:
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", raw, re.I):
                put("person", m, name)
        for m in _ORG.finditer(raw):
            if len(m[1]) <= 80:
                put("organization", m, m[1])
        if (m := _CELL.match(raw)) and not m[1][-1:].isdigit() and not m[2].startswith("/"):
            a, b = m.span(2)
            out.append(Candidate("cell", raw[a:b], at + a, at + b, no, raw[a:b], m[1].strip(), None))
        prev = raw.strip()
    return clean(out)


def clean(found: list[Candidate]) -> list[Candidate]:
    """Sorted by place and kind, one per span and kind; generic kinds inside specific ones are dropped and hand on their label."""
    rank = {k: i for i, k in enumerate(ORDER)}
    found = sorted(found, key=lambda c: (c.start, rank[c.kind], -c.end))
    seen, once = set(), []
    for c in found:
        if (c.start, c.end, c.kind) not in seen:
            seen.add((c.start, c.end, c.kind))
            once.append(c)
    specific = [c for c in once if c.kind not in GENERIC]
    starts = sorted(c.start for c in specific)
    begun, reach = set(starts), list(accumulate((c.end for c in sorted(specific, key=lambda c: c.start)), max))

    def met(c: Candidate) -> bool:
        """Whether a specific candidate overlaps: of those that begin before its end, the farthest reach decides."""
        n = bisect_left(starts, c.end)
        return n > 0 and reach[n - 1] > c.start

    out = []
    labels: dict[tuple[int, int], str] = {}
    for c in once:
        if c.kind in GENERIC and c.kind != "cell" and met(c):
            if c.label:
                labels[c.start, c.end] = c.label
            continue
        if c.kind == "cell":
            labels.setdefault((c.start, c.end), c.label or "")
            if c.start in begun or met(c):
                continue
        out.append(c)
    # Both come in the order of their starts: a label whose end is passed holds no later candidate.
    named, todo, still = [], deque((a, b, v) for (a, b), v in labels.items() if v), []
    for c in out:
        while todo and todo[0][0] <= c.start:
            still.append(todo.popleft())
        still = [x for x in still if x[1] >= c.start]
        named.append(c if c.label else c._replace(label=next((v for _, b, v in still if c.end <= b), None)))
    out = named
    if len(out) > MOST:
        best = sorted(out, key=lambda c: (not c.checksum, c.label is None, rank[c.kind], c.start))[:MOST]
        out = sorted(best, key=lambda c: (c.start, rank[c.kind], -c.end))
    return out
