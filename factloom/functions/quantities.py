"""Reading of amounts as people and machines write them: number formats, currency, unit, scale and recurrence."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

# Spellings of currencies, units and recurrences.
CURRENCIES = {
    "eur": "EUR", "euro": "EUR", "euros": "EUR", "€": "EUR", "usd": "USD", "us$": "USD", "$": "USD", "dollar": "USD",
    "chf": "CHF", "fr.": "CHF", "fr": "CHF", "sfr": "CHF", "sfr.": "CHF", "gbp": "GBP", "£": "GBP", "sek": "SEK", "skr": "SEK", "kr": "SEK", "kr.": "SEK",
    "czk": "CZK", "kč": "CZK", "dem": "DEM", "dm": "DEM", "pln": "PLN", "zł": "PLN",
}
SCALED_CURRENCIES = {
    "ct": ("EUR", 0.01), "cent": ("EUR", 0.01), "cents": ("EUR", 0.01), "eurct": ("EUR", 0.01), "eurocent": ("EUR", 0.01),
    "teur": ("EUR", 1000.0), "t€": ("EUR", 1000.0), "keur": ("EUR", 1000.0), "k€": ("EUR", 1000.0), "tsd. eur": ("EUR", 1000.0), "mio. eur": ("EUR", 1e6), "meur": ("EUR", 1e6),
}
UNITS = {
    "kwh": ("kWh", 1.0), "wh": ("kWh", 0.001), "mwh": ("kWh", 1000.0), "gwh": ("kWh", 1e6), "mj": ("kWh", 1 / 3.6), "gj": ("kWh", 1000 / 3.6),
    "m²": ("m²", 1.0), "m2": ("m²", 1.0), "qm": ("m²", 1.0), "quadratmeter": ("m²", 1.0), "sqft": ("m²", 0.09290304), "sq ft": ("m²", 0.09290304), "ha": ("m²", 1e4),
    "km": ("km", 1.0), "kilometer": ("km", 1.0), "tkm": ("km", 1000.0), "m": ("km", 0.001), "mi": ("km", 1.609344), "miles": ("km", 1.609344), "meilen": ("km", 1.609344),
    "m³": ("m³", 1.0), "m3": ("m³", 1.0), "cbm": ("m³", 1.0), "kubikmeter": ("m³", 1.0), "l": ("m³", 0.001), "liter": ("m³", 0.001), "litre": ("m³", 0.001), "hl": ("m³", 0.1),
    "kg": ("kg", 1.0), "kilogramm": ("kg", 1.0), "g": ("kg", 0.001), "gramm": ("kg", 0.001), "t": ("kg", 1000.0), "tonnen": ("kg", 1000.0), "lb": ("kg", 0.45359237), "lbs": ("kg", 0.45359237),
}
_PERIOD_STEMS = (
    (2.0, r"half[ _-]?year|semi-?annual|halbj|halbes jahr|six months|6 months|semest"),
    (4.0, r"quarter|quartal|viertelj|trimest|three months|3 months"),
    (12.0, r"month|monat|mtl|mensu|par mois|al mes|p\.? ?m\b"),
    (52.0, r"week|woche|wöchent|hebdo|seman"),
    (1.0, r"year|jahr|jährl|annu|par an\b|al año|anual|p\.? ?a\b"),
)
_PERIODS = tuple((n, re.compile(p)) for n, p in _PERIOD_STEMS)
_NUMBER = re.compile(r"[-+−]?\d(?:[\d.,'’   ]*\d)?")
_THOUSAND = re.compile(r"thousand|tsd|tausend|mille|miles de|\bin t(?:€|eur)", re.I)
_CENTS = re.compile(r"\bcents?\b|\bct\b|centimes|céntimos", re.I)
_GROUPS = re.compile(r"['’   ]")
_SPACES = re.compile(r"\s+")


class Reading(NamedTuple):
    """number as written times what is stated; currency or unit None where no text says it; per_year None likewise; decimals: written with them."""

    value: float
    base: str | None
    scale_stated: bool
    per_year: float | None
    ambiguous: float | None
    decimals: bool = False


def number(text: str, decimals_only: bool = False) -> tuple[float, float | None] | None:
    """The number in digits with group and decimal marks of any country, and its other reading if a single mark before
    three digits could be either. None if there is no number."""
    t = _GROUPS.sub("", text).replace("−", "-")
    last = max(t.rfind("."), t.rfind(","))
    if last < 0:
        return (float(t), None) if re.fullmatch(r"[-+]?\d+", t) else None
    mark, other = t[last], "," if t[last] == "." else "."
    head, tail = t[:last], t[last + 1 :]
    try:
        if other in head:
            return (float(head.replace(other, "") + "." + tail), None) if mark not in head else None
        if mark in head:
            return float(t.replace(mark, "")), None
        as_decimal = float(head + "." + tail)
        if len(tail) == 3 and re.fullmatch(r"[-+]?[1-9]\d{0,2}", head) and not decimals_only:
            return float(head + tail), as_decimal
        return as_decimal, None
    except ValueError:
        return None


def has_decimals(text: str) -> bool:
    """Whether a number is written with decimals, be they zeros; a single mark before three digits groups, as number() reads it."""
    t = _GROUPS.sub("", text)
    last = max(t.rfind("."), t.rfind(","))
    if last < 0 or t[last] in t[:last]:
        return False
    head, tail = t[:last], t[last + 1 :]
    return "," in head or "." in head or not (len(tail) == 3 and re.fullmatch(r"[-+−]?[1-9]\d{0,2}", head))


@lru_cache(maxsize=20_000)
def recurrence(text: str) -> float | None:
    """How often a year, by the words of a text; None if they name no period."""
    t = text.lower().replace("_", " ")
    return next((n for n, p in _PERIODS if p.search(t)), None)


@lru_cache(maxsize=20_000)
def _measure(text: str, money: bool) -> tuple[str | None, float, bool, float | None]:
    """Base, factor, whether a scale is stated and recurrence of the words around a number."""
    t = _SPACES.sub(" ", text.strip().lower())
    per = recurrence(t) if money and t else None
    if not money:
        u = UNITS.get(t) or UNITS.get(t.rstrip(".")) or next((UNITS[w] for w in t.split(" ") if w in UNITS), None)
        return (u[0], u[1], True, None) if u else (None, 1.0, False, None)
    scale, stated, base = 1.0, False, None
    for w in re.split(r"[ /]+", t):
        if w in SCALED_CURRENCIES:
            base, scale = SCALED_CURRENCIES[w]
            stated = True
        elif w in CURRENCIES:
            base = CURRENCIES[w]
        elif w in ("k", "tsd", "tsd."):
            scale, stated = 1000.0, True
    return base, scale, stated, per


def read(amount: str | None, currency: str | None, unit: str | None, period: str | None, context: str | None, money: bool) -> Reading | None:
    """What one row states. Text beside the number counts before the columns, these before the context quote. None without a number."""
    m = _NUMBER.search(amount) if amount else None
    if not m:
        return None
    around = amount[: m.start()] + " " + amount[m.end() :]
    base, scale, stated, per = _measure(around, money) if around.strip() else (None, 1.0, False, None)
    b2, s2, st2, _ = _measure(currency if money else unit, money) if (currency if money else unit) else (None, 1.0, False, None)
    base = base or b2
    if not stated and st2:
        scale, stated = s2, True
    per = per or (recurrence(period) if money and period else None)
    if context:
        if money:
            per = per or recurrence(context)
            if not stated and (_THOUSAND.search(context) or _CENTS.search(context)):
                scale, stated = (1000.0 if _THOUSAND.search(context) else 0.01), True
        elif base is None:
            base, scale, stated, _ = _measure(context.rpartition(":")[2], False)
    n = number(m.group(), decimals_only=scale >= 1000 and money)
    if n is None or not math.isfinite(n[0]):
        return None
    return Reading(n[0] * scale, base, stated, per, None if n[1] is None else n[1] * scale, has_decimals(m.group()))
