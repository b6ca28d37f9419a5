"""Noise in text from scanned pages: split words, misread characters, running headers and page numbers (problem 1)."""

from __future__ import annotations

import copy
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from factloom.sources.tables import checkpoint

# Confusable glyphs (what a reader takes for another is written in the same strokes), characters that end a
# split line, words that follow a suspended compound, and how pages are numbered.
STROKES = {
    "m": "rn", "d": "cl", "h": "ll", "w": "vv", "u": "ll", "ü": "ll", "c": "c", "e": "c", "f": "t", "t": "t", "q": "g", "g": "g",
    "i": "l", "l": "l", "1": "l", "|": "l", "o": "o", "0": "o", "s": "s", "5": "s", "b": "b", "8": "b", "ß": "b",
}
DAMAGE = {
    "rn": ("m",), "m": ("rn",), "d": ("cl",), "cl": ("d",), "h": ("li", "l1", "1i", "lI"), "w": ("vv",), "u": ("ii",), "ü": ("ii",), "n": ("ri",), "e": ("c",), "c": ("e",),
    "t": ("f",), "f": ("t",), "g": ("q",), "q": ("g",), "i": ("1", "l", "I", "|"), "l": ("1", "I", "i", "|"), "I": ("l", "1"), "o": ("0", "O"), "O": ("0",), "s": ("5",), "S": ("5",), "b": ("8",), "B": ("8",), "ß": ("B", "8"),
}
HYPHENS = "-‐‑=¬­"
SUSPENDED = frozenset("und oder bzw sowie u et ou and or y o e ni noch".split())
NUMBER_LETTERS = "IlOoSB"
PAGE_WORDS = r"(?:seite|page|página|pagina|pág\.?|pag\.?|blatt|s\.|p\.|hoja|feuille|sheet|bl\.)"

#: A form is known with this count. The tasks hold the groups (forms of one skeleton) with the most frequent forms, whole groups
#: of at most so many forms in all; a text brings the groups of its other words along, so what is held changes no result.
LEAST, MOST_FORMS = 3, 300_000
#: A frequent form is itself a misreading of a form in its group that comes this many times as often.
RATIO = 12
FLUSH = 300_000
#: Lines at each end of a page that can hold a header or a page number.
EDGE = 2

_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
# Strokes that a form can have; the lower case of "İ" has a dot of its own.
_STROKED = re.compile("(?:[^\\W\\d_]|-|\u0307)+")
_JOIN = re.compile(f"[{HYPHENS}][ \\t\\r]*\n[ \\t]*(?=[a-zäöüßéèêàâçñóúíáîôû])")
_TOKEN = re.compile(r"[^\s.,;:()!?\"„“”«»/]+")
_SPLIT = re.compile(f"([^\\W_]+)[{HYPHENS}][ \\t\\r]*$")
_START = re.compile(r"[ \t]*([^\W_]+)")
_MIXED = re.compile(f"(?<!\\w)[€$£]?[0-9{NUMBER_LETTERS}]+(?:[.,/:’'-]?[0-9{NUMBER_LETTERS}]+)*(?!\\w)")
_TOUCH = re.compile(f"[0-9][.,/:’'-]?[{NUMBER_LETTERS}]|[{NUMBER_LETTERS}][.,/:’'-]?[0-9]")
_CODE = re.compile(f"[{NUMBER_LETTERS}][0-9]{{5,}}")
_ID = re.compile(f"^[A-Z]{{1,3}}-[0-9{NUMBER_LETTERS}]{{5,9}}$")
_NUMERIC = re.compile(f"^[+–-]?[€$£]?[0-9{NUMBER_LETTERS}]+(?:[.,/:’'-][0-9{NUMBER_LETTERS}]+)*[€%]?$")
_HAS_LETTER = re.compile(f"[{NUMBER_LETTERS}]")
_HAS_DIGIT = re.compile("[0-9]")
_WEIRD = re.compile("[^\\x00-\\x7fäöüÄÖÜßéèêàâçñóúíáîôûëïùœÉÀÁÓÚÍÑÇÈÊÎ€’‘–‐‑¬­²³°§º]")
_TO_DIGIT = str.maketrans({"I": "1", "l": "1", "O": "0", "o": "0", "S": "5", "B": "8", "|": "1"})
_FIELDS = re.compile(r"\||·|\s{2,}|\t| – ")
_NUM = f"[0-9{NUMBER_LETTERS}|]{{1,4}}"
_PAGE_ALONE = re.compile(rf"^\W*(?:{PAGE_WORDS}\s*)?({_NUM})\W*$|^\W*(?:{PAGE_WORDS}\s*)?({_NUM})\s*(?:/|\||von|of|sur|de|-)\s*{_NUM}\W*$", re.I)
_PAGE_BESIDE = re.compile(rf"^(.*?\S)(?:\s{{2,}}|\s+[–—|·-]\s+|\t)(?:\W*(?:{PAGE_WORDS}\s*)?({_NUM})\W*|\W*(?:{PAGE_WORDS}\s*)?({_NUM})\s*(?:/|\||von|of|sur|de)\s*{_NUM}\W*)$", re.I)
_PAGE_BEFORE = re.compile(rf"^(?:\W*(?:{PAGE_WORDS}\s*)?({_NUM})\W*|\W*(?:{PAGE_WORDS}\s*)?({_NUM})\s*(?:/|\||von|of|sur|de)\s*{_NUM}\W*)(?:\s{{2,}}|\s+[–—|·-]\s+|\t)(\S.*)$", re.I)
_TAIL = re.compile(f"(?:^|[^\\w]){_NUM}[^\\w]*$")
_HEAD = re.compile(rf"^\W*(?:{PAGE_WORDS}\s*)?{_NUM}(?!\w)", re.I)
_LETTERS = re.compile(r"[^\W\d_]{3}")
_STRIP, _PARTS = "-–—'’‘*|=[]+", re.compile(r"[-‐’']")
_BEYOND = re.compile("[^\\x00-\\x7f]+")
_BODY = re.compile(r":|[-‐=¬\xad]\s*$|[.,;!?]\s*$|^\d+\.\s")


def damaged(true: str, seen: str) -> bool:
    """Whether what is seen can be the true word with glyphs read as others, one for one."""
    n, m = len(true), len(seen)
    front = {(0, 0)}
    while front:
        back = set()
        for i, j in front:
            if i == n:
                if j == m:
                    return True
                continue
            if j < m and (true[i] == seen[j] or true[i].lower() == seen[j].lower()):
                back.add((i + 1, j + 1))
            for k in (1, 2):
                for d in DAMAGE.get(true[i : i + k], ()) if i + k <= n else ():
                    if seen.startswith(d, j):
                        back.add((i + k, j + len(d)))
        front = back
    return False


def skeleton(word: str) -> str:
    """A word in strokes: words that readers confuse have the same; case does not count."""
    return word.lower().translate(_STROKES)


def _plain(word: str) -> str:
    """Without case and umlaut points: words that differ in these alone are both proper."""
    return word.lower().replace("ü", "u")


_STROKES = str.maketrans(STROKES)


def bigrams(parts: DataFrame, text: str = "text") -> DataFrame:
    """prev, word, n of all texts, counted in the tasks ahead of the shuffle; prev is '' for the first word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(a, b, n) for (a, b), n in c.items()], columns=["prev", "word", "n"])

        for b in batches:
            for t in b[text]:
                if t:
                    w = _WORD.findall(_JOIN.sub("", t))
                    c.update(zip(["", *w], w))
            if len(c) > FLUSH:
                yield out()
                c.clear()
        yield out()

    got = parts.select(text).filter(F.col(text).isNotNull()).mapInPandas(count, "prev string, word string, n long")
    return got.groupBy("prev", "word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Known forms in whole groups by skeleton, and which of them are misreadings. whole: no group is left out."""

    def __init__(self, forms: dict[str, int], context: dict[tuple[str, str], int], whole: bool = True):
        self.forms, self.context, self.whole = forms, context, whole
        self.groups: dict[str, list[str]] = {}
        for f in sorted(forms, key=lambda x: (-forms[x], x)):
            self.groups.setdefault(skeleton(f), []).append(f)
        self.wrong: dict[str, str] = {}
        for g in self.groups.values():
            top = g[0]
            for f in g[1:]:
                if forms[f] * RATIO <= forms[top] and _plain(f) != _plain(top) and damaged(top, f):
                    self.wrong[f] = top
        self.fine = frozenset(f for f in forms if f not in self.wrong)
        self.memo: dict[str, int] = {}

    def more(self, forms: dict[str, int]) -> Lexicon:
        """With the forms of further whole groups."""
        if not forms:
            return self
        other, out = Lexicon(forms, {}), copy.copy(self)
        out.forms, out.groups, out.wrong = {**self.forms, **other.forms}, {**self.groups, **other.groups}, {**self.wrong, **other.wrong}
        out.fine, out.memo = self.fine | other.fine, {}
        return out

    def candidates(self, word: str) -> list[str]:
        """The proper forms that an unknown word can be a misreading of, the most frequent first."""
        g = [f for f in self.groups.get(skeleton(word), ()) if f in self.fine and damaged(f, word)]
        low = _plain(word)
        return [] if any(_plain(f) == low for f in g) else g

    def choices(self, word: str) -> list[str]:
        """The candidates of an unknown word, if the word before chooses from them: where forms of its group differ in more than
        case."""
        if word in self.forms or len(g := self.candidates(word)) < 2:
            return []
        return g if len({f.lower() for f in self.groups[skeleton(word)] if f in self.fine}) > 1 else []

    def meant(self, word: str, prev: str | None = None, hints: dict | None = None) -> str | None:
        """The known form a word is a misreading of, or None. Of several forms of a group the one that follows the previous
        word most often is taken, then the most frequent. A frequent form is no misreading after a word that it follows again
        and again and the other form does not. hints: such pairs of words, and how often pairs to choose from come."""
        if word in self.fine:
            return None
        if word in self.wrong:
            return None if hints and (prev, word) in hints else self.wrong[word]
        g = self.candidates(word)
        if len(g) > 1:
            seen = hints or self.context
            return max(g, key=lambda f: (seen.get((prev, f), 0), self.forms[f]))
        return g[0] if g else None

    def misread(self, token: str) -> int:
        """0: proper; 1: misread; 2: misread or not, by the word before it."""
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[token] = self._misread(token)
        return got

    def _misread(self, token: str) -> int:
        t = token.strip(_STRIP)
        if _ID.match(t) and not _WEIRD.search(t):
            return int(bool(_HAS_LETTER.search(t.partition("-")[2])))
        if _no_words(t):
            return 0
        at = [0]
        for p in _PARTS.split(t):
            if len(p) > 1 and p not in self.fine:
                at.append(2 if p in self.wrong else int(self.meant(p) is not None))
        return next(x for x in (1, 2, 0) if x in at)


def _no_words(t: str) -> bool:
    """Whether a token without marks around it holds no words to judge. Numbers are judged whole, see wrong_number."""
    return bool(not t or _WEIRD.search(t) or _ID.match(t) or _HAS_DIGIT.search(t) and _NUMERIC.match(t))


def _asked(token: str) -> set[str]:
    """The words that the verdict on a token and its repair look for."""
    out, t = {token} if _WORD.fullmatch(token) else set(), token.strip(_STRIP)
    return out if _no_words(t) else out | {p for x in (t, token) for p in _PARTS.split(x) if p}


def wrong_number(text: str) -> bool:
    """Whether a number of the text, with its marks, holds letters that look like digits. A letter before five digits or more
    is a code."""
    if not _TOUCH.search(text):
        return False
    return any(_HAS_LETTER.search(n) and _HAS_DIGIT.search(n) and not _CODE.fullmatch(n) for n in _MIXED.findall(text))


@F.pandas_udf(StringType())
def _strokes(word: pd.Series) -> pd.Series:
    """skeleton, as a column."""
    return word.map(skeleton)


_FORMS = "array<struct<word:string,n:bigint>>"


class Words(NamedTuple):
    """What all texts say of words: the lexicon for the tasks, all groups of known forms (strokes, top, forms), frequent pairs of
    words (prev, word, n), and those of them that come again and again where the form that the word is taken for a misreading
    of does not (prev, word)."""

    lex: Lexicon
    groups: DataFrame
    often: DataFrame
    alone: DataFrame


def lexicon(parts: DataFrame, text: str = "text", most: int = MOST_FORMS) -> Words:
    """The words of all texts. What reaches the driver is bounded: groups of at most `most` forms in all."""
    pairs = checkpoint(bigrams(parts, text))
    often = pairs.filter(F.col("n") >= LEAST)
    words = pairs.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).withColumn("strokes", _strokes("word"))
    groups = checkpoint(words.groupBy("strokes").agg(F.max("n").alias("top"), F.collect_list(F.struct("word", "n")).alias("forms")))
    # All groups of a greatest count or none.
    floor, total, whole = None, 0, True
    for r in groups.groupBy("top").agg(F.sum(F.size("forms")).alias("n")).orderBy(F.desc("top")).limit(most + 1).collect():
        total += r["n"]
        if total > most:
            whole = False
            break
        floor = r["top"]
    held = groups.filter(F.col("top") >= F.lit(floor)).select(F.inline("forms"))
    lex = Lexicon({r["word"]: r["n"] for r in held.toLocalIterator()}, {}, whole)

    def misreadings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [x for fs in b["forms"] for x in Lexicon({f["word"]: f["n"] for f in fs}, {}).wrong.items()]
            yield pd.DataFrame(out, columns=["word", "top"])

    least = F.array_min(F.transform("forms", lambda f: f["n"]))
    wrong = checkpoint(groups.filter(F.col("top") >= RATIO * least).select("forms").mapInPandas(misreadings, "word string, top string"))
    of = F.broadcast(wrong) if wrong.count() <= most else wrong
    alone = often.join(of, "word").join(often.select("prev", F.col("word").alias("top")), ["prev", "top"], "left_anti").select("prev", "word")
    return Words(lex, groups, often, alone)


def missing(text: str, lex: Lexicon) -> set[str]:
    """Skeletons of all words that the verdicts on a text and its repair look for, where the lexicon does not hold their group."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    tokens, words = set(_TOKEN.findall(text)), set()
    for i, x, y in _ends(lines):
        words |= {x + y, f"{x}-{y}"}
        tokens.update(_TOKEN.findall(_joined(lines[i], lines[i + 1], x + y)[0]))
    for w in tokens - lex.fine:
        words |= _asked(w)
    return {k for k in map(skeleton, words) if k not in lex.groups and _STROKED.fullmatch(k)}


def _brought(rows: DataFrame, words: Words, shared) -> DataFrame:
    """segment_id, forms: the known forms of the groups that a text needs and the tasks do not hold. One row per text that has any."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {(seg, k) for seg, t in zip(b["segment_id"], b["text"]) for k in missing(t, shared.value)}
            yield pd.DataFrame(list(out), columns=["segment_id", "strokes"])

    asked = rows.filter("text is not null").select("segment_id", "text").mapInPandas(ask, "segment_id string, strokes string").distinct()
    return checkpoint(asked.join(words.groups, "strokes").groupBy("segment_id").agg(F.flatten(F.collect_list("forms")).alias("forms")))


def _with_forms(rows: DataFrame, words: Words, shared) -> DataFrame:
    """Rows with a column forms, see _brought; null where the tasks hold all that a text needs."""
    if words.lex.whole:
        return rows.withColumn("forms", F.lit(None).cast(_FORMS))
    return rows.join(_brought(rows, words, shared), "segment_id", "left")


def _of_batch(lex: Lexicon, forms: pd.Series) -> Lexicon:
    """The lexicon with the forms that the texts of a batch bring along. No text looks for a group that only another brings."""
    return lex.more({f["word"]: f["n"] for fs in forms if fs is not None for f in fs})


def _ends(lines: list[str]) -> Iterator[tuple[int, str, str]]:
    """Numbers of lines that end within what may be a word, with its two parts."""
    for i in range(len(lines) - 1):
        line = lines[i]
        end = line.rstrip(" \t\r")[-1:]
        if not end or end not in HYPHENS:
            continue
        a, b = _SPLIT.search(line), _START.match(lines[i + 1])
        if not a or not b:
            continue
        x, y = a.group(1), b.group(1)
        if y.lower() in SUSPENDED or x.isdigit() or y[0].isdigit() and x[-1].isdigit():
            continue
        if end == "¬" and _WEIRD.search(x[-1]):  # the end of a wrongly decoded sign
            continue
        yield i, x, y


def split_words(lines: list[str], lex: Lexicon) -> dict[int, str]:
    """Numbers of lines whose last word goes on in the next line only because the line was full -> the whole word."""
    out = {}
    for i, x, y in _ends(lines):
        whole = x + y
        known = lex.forms.get(whole, 0) or lex.forms.get(whole.lower(), 0)
        if not known:
            known = sum(lex.forms[f] for f in lex.groups.get(skeleton(whole), ()))
        real = lex.forms.get(f"{x}-{y}", 0)
        if y[0].isupper() and not (x.isupper() and len(x) > 1) and not known:
            continue
        if real > known:
            continue
        out[i] = whole
    return out


def _joined(line: str, nxt: str, whole: str) -> tuple[str, int]:
    """A line with its split last word whole and what is joined to it in the next line, and where the next line goes on."""
    at = _START.match(nxt).end()
    end = re.match(r"\S*", nxt[at:]).end() + at
    return (line[: _SPLIT.search(line).start(1)].strip() + " " + whole + nxt[at:end]).strip(), end


def page_number(line: str, page: int | None) -> tuple[bool, str]:
    """Whether a line holds the page's own number alone or beside a header, and the line without it."""

    def own(*found: str | None) -> bool:
        n = next((x for x in found if x), "").translate(_TO_DIGIT)
        return n.isdigit() and (page is None or int(n) == page)

    t = line.strip()
    if not _TAIL.search(t) and not _HEAD.match(t):
        return False, t
    if m := _PAGE_ALONE.match(t):
        return (True, "") if own(m.group(1), m.group(2)) and _HAS_DIGIT.search(t.translate(_TO_DIGIT)) else (False, t)
    if (m := _PAGE_BESIDE.match(t)) and own(m.group(2), m.group(3)):
        return True, m.group(1)
    if (m := _PAGE_BEFORE.match(t)) and own(m.group(1), m.group(2)):
        return True, m.group(3)
    return False, t


def _keyed(low: str) -> str:
    return re.sub(r"[\W\d_]+", " ", low.translate(_STROKES)).strip() or low


def running(line: str, page: int | None) -> list[str]:
    """What stays the same in a line whose numbers run with the pages: for each number, its distance from the page and the other
    numbers."""
    if page is None:
        return []
    numbers = re.findall(r"\d+", line.translate(_TO_DIGIT) if _TOUCH.search(line) else line)
    return ["|".join([f"{int(n) - page:+d}" if j == i else m for j, m in enumerate(numbers)]) + f"@{i}" for i, n in enumerate(numbers) if len(n) <= 9] if len(numbers) <= 4 else []


def edges(lines: list[str], page: int | None) -> tuple[set[int], dict[int, list[tuple[str, str]]]]:
    """Lines with the page's number, and of the lines at both ends that may be headers: keys (side and strokes, digits masked;
    for lines beyond ASCII also without such letters, as wrong decoding changes them) with digits."""
    at = [i for i, x in enumerate(lines) if x.strip()]
    ends = {**{i: "top" for i in at[:EDGE]}, **{i: "bottom" for i in at[max(EDGE, len(at) - EDGE) :]}}
    width = max(map(len, lines))
    numbered, heads = set(), {}
    key = lambda k, numbers: [(k, n) for n in numbers]
    for i, side in ends.items():
        outer = i in (at[0], at[-1])
        # A second line counts only beside furniture of its edge.
        if not outer and _BODY.search(out := lines[at[0] if side == "top" else at[-1]]) and _LETTERS.search(out) and not page_number(out, page)[0]:
            continue
        hit, rest = page_number(lines[i], page)
        if hit and (outer or (rest == "" and len(at) > 3)):
            numbered.add(i)
        else:
            rest = lines[i].strip()
        if rest and 3 < len(rest) <= 120 and not _BODY.search(rest) and (side == "bottom" or len(rest) < 0.7 * width or _FIELDS.search(rest)):
            digits = "".join(c for c in rest.translate(_TO_DIGIT) if c.isdigit()) if _HAS_DIGIT.search(rest) else ""
            low = re.sub(r"\S*\d\S*", "0", rest.lower())
            numbers = [digits, *running(rest, page)] if outer and digits else [digits]
            heads[i] = key(f"{side} {_keyed(low)}", numbers)
            if not rest.isascii():
                heads[i] += key(f"{side}~{_keyed(_BEYOND.sub('', low))}", numbers)
    return numbered, heads


def in_context(text: str, words: set[str], lex: Lexicon) -> set[tuple[str, str]]:
    """Where the words, frequent forms that mostly are misreadings, stand: (word before, word)."""
    of = {p for w in words for p in _PARTS.split(w.strip(_STRIP)) if p in lex.wrong}
    w = _WORD.findall(_JOIN.sub("", text))
    return {(prev, p) for prev, x in zip(["", *w], w) for p in (x.split("-") if "-" in x else (x,)) if p in of}


def _page(page, ordinal) -> int | None:
    return int(page) if page == page and page is not None else (int(ordinal) if ordinal == ordinal and ordinal is not None else None)


def to_choose(text: str, lex: Lexicon, tokens: set[str], split: dict[int, str], ends: set[int]) -> set[tuple[str, str]]:
    """Where the word before chooses what a word means: (strokes of the word before, form to choose). Whatever is chosen for the
    word before, its strokes are the same. ends: lines that may be dropped; any of them with a split word changes the next line."""
    if split:
        lines = [x.rstrip("\r") for x in text.split("\n")]
        tokens = tokens.union(*[_TOKEN.findall(_joined(lines[i], lines[i + 1], w)[0]) for i, w in split.items()])
    out: set[tuple[str, str]] = set()
    if any(lex.choices(p) for w in tokens if lex.misread(w) for p in _asked(w)):
        ends = ends & split.keys()
        for n in range(len(ends) + 1):
            for drop in itertools.combinations(sorted(ends), n):
                repaired_lines(text, lex, frozenset(drop), choose=out)
    return out


def _scan(shared, choose: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lex, out = _of_batch(shared.value, b["forms"]), []
            for seg, src, page, ordinal, t in b[["segment_id", "source_id", "page", "ordinal", "text"]].itertuples(index=False):
                lines = t.split("\n")
                split = split_words(lines, lex)
                if split:
                    out.append((seg, src, "hyphen", None, None))
                numbered, heads = edges(lines, _page(page, ordinal))
                if numbered:
                    out.append((seg, src, "page_number", None, None))
                out += [(seg, src, "edge", key, digits) for keys in heads.values() for key, digits in keys]
                words = {w for w in set(_TOKEN.findall(t)) - lex.fine if not w.isdigit()}
                if choose:
                    out += [(seg, src, "choose", k, f) for k, f in to_choose(t, lex, words, split, numbered | heads.keys())]
                if split:
                    for i, whole in split.items():
                        words.add(whole)
                        words.discard(_SPLIT.search(lines[i]).group(0).strip())
                        words.discard(_START.match(lines[i + 1]).group(1))
                verdicts = {w: lex.misread(w) for w in words}
                by_context = {w for w, x in verdicts.items() if x == 2}
                if 1 in verdicts.values() or wrong_number(t):
                    out.append((seg, src, "chars", None, None))
                if by_context:
                    out += [(seg, src, "context", prev, word) for prev, word in in_context(t, by_context, lex)]
            yield pd.DataFrame(out, columns=["segment_id", "source_id", "kind", "key", "digits"])

    return run


def _scanned(rows: DataFrame, shared, choose: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the scan of all texts finds, and of it the header lines (segment_id, key, digits)."""
    got = checkpoint(rows.mapInPandas(_scan(shared, choose), "segment_id string, source_id string, kind string, key string, digits string"))
    edge = got.filter("kind = 'edge' and source_id is not null")
    # Numbers tell a header from lines of one shape: they must agree or run with the pages.
    keys = edge.groupBy("source_id", "key", "digits").agg(F.min("segment_id").alias("a"), F.max("segment_id").alias("b")).filter("a <> b").select("source_id", "key", "digits")
    return got, edge.join(keys, ["source_id", "key", "digits"], "left_semi")


def defects(parts: DataFrame, most: int = MOST_FORMS) -> DataFrame:
    """segment_id, defect (hyphen, chars, header, page_number): one row per part and defect in it.

    hyphen: a line ends in a hyphen sign and the next goes on with the word; suspended compounds, names and words written
    with a hyphen are none. chars: a word outside the proper forms has the skeleton of one and its place in the text does not speak for it, or a number
    holds letters. page_number: page (or ordinal where it is null), alone or beside a header at the top or bottom. header: a line
    at an end whose key (digits masked) comes at the same end of at least two parts of the source, with the same numbers or with
    one that runs with the pages. Keys are counted per source and key ahead
    of the join, so a source of any size is no single task. Null texts have no defects; the result holds parts that
    repeat once (texts are not shuffled for that, so words of repeated rows count again in the lexicon);
    words with wrongly decoded characters are left to the encoding operator. Other columns are ignored.
    """
    rows = parts.filter("text is not null and segment_id is not null").select("segment_id", "source_id", F.col("page").cast("double").alias("page"), F.col("ordinal").cast("double").alias("ordinal"), "text")
    words = lexicon(rows, most=most)
    shared = rows.sparkSession.sparkContext.broadcast(words.lex)
    got, heads = _scanned(_with_forms(rows, words, shared), shared)
    found = got.filter("kind in ('hyphen', 'page_number', 'chars')").select("segment_id", F.col("kind").alias("defect")).unionByName(heads.select("segment_id", F.lit("header").alias("defect")))
    context = got.filter("kind = 'context'").select("segment_id", F.col("key").alias("prev"), F.col("digits").alias("word"))
    found = found.unionByName(context.join(words.alone, ["prev", "word"], "left_anti").select("segment_id", F.lit("chars").alias("defect")))
    return found.distinct()


def repaired_lines(text: str, lex: Lexicon, drop: frozenset[int] = frozenset(), hints: dict | None = None, choose: set | None = None) -> list[tuple[int, str, int]]:
    """(number, text, length as printed) of the lines of a part, blank ones included: headers and number lines dropped, split words
    whole in their first line, misread words and numbers repaired. Into choose go the forms to choose from, see to_choose."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    split = split_words(lines, lex)
    out = []
    for i, raw in enumerate(lines):
        if i in drop:
            continue
        line, length = raw.strip(), len(raw.rstrip())
        if i in split:
            nxt = lines[i + 1]
            line, end = _joined(raw, nxt, split[i])
            lines[i + 1] = " " * (len(nxt) - len(nxt[end:].strip())) + nxt[end:].strip()
            if not lines[i + 1].strip():
                length, drop = len(nxt.rstrip()), drop | {i + 1}
        prev, pieces = "", []
        for token in re.split(r"(\s+)", line):
            fixed = _TOKEN.sub(lambda m: repair(m.group(), lex, prev, hints, choose), token)  # noqa: B023
            pieces.append(fixed)
            prev = (_WORD.findall(fixed) or [prev])[-1]
        out.append((i, "".join(pieces), length))
    return out


def repair(token: str, lex: Lexicon, prev: str = "", hints: dict | None = None, choose: set | None = None) -> str:
    """A misread token as it was meant, or itself."""
    if token in lex.fine:
        return token
    if _ID.match(token):
        head, dash, tail = token.partition("-")
        return head + dash + tail.translate(_TO_DIGIT)
    if _HAS_DIGIT.search(token) and _NUMERIC.match(token) and not _CODE.fullmatch(token):
        return token.translate(_TO_DIGIT)
    if not lex.misread(token):
        return token
    if choose is not None:
        choose.update((skeleton(prev), f) for p in _asked(token) for f in lex.choices(p))
    return "".join(lex.meant(p, prev, hints) or p if p and p not in "-‐’'" else p for p in re.split(r"([-‐’'])", token))


def reflow(lines: DataFrame) -> DataFrame:
    """segment_id, text: lines (segment_id, no, line, length) as continuous paragraphs, by SQL windows.

    A paragraph begins with a label ("Contract number: ..."), after a blank line, after a line that ends in a colon, and after a line that ends a sentence or holds a label
    and is shorter than three quarters of the part's longest. Lines of a paragraph are joined by blanks, paragraphs by an empty line."""
    part = Window.partitionBy("segment_id")
    w = part.orderBy("no")
    full = lines.withColumns({"_width": F.max("length").over(part), "_before": F.lag("line").over(w), "_length": F.lag("length").over(w)})
    ends = F.col("_before").rlike(r"[.!?,:]$") | F.contains("_before", F.lit(": "))
    label = F.col("line").rlike(r"^\p{Lu}[\p{L} .’-]{1,40} ?: ")
    fresh = label | F.col("_before").isNull() | (F.col("_before") == "") | F.endswith("_before", F.lit(":")) | (ends & (F.col("_length") < 0.75 * F.col("_width")))
    full = full.withColumn("_para", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("line <> ''")
    joined = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", c))), lambda x: x[c]), sep)
    paras = full.groupBy("segment_id", "_para").agg(joined("line", " ").alias("text"), F.min("no").alias("no"))
    return paras.groupBy("segment_id").agg(joined("text", "\n\n").alias("text"))


def restored(parts: DataFrame, most: int = MOST_FORMS) -> DataFrame:
    """segment_id, text: every part as continuous paragraphs (null texts stay null, repeated parts come once)."""
    rows = parts.filter("segment_id is not null").select("segment_id", "source_id", F.col("page").cast("double").alias("page"), F.col("ordinal").cast("double").alias("ordinal"), "text").dropDuplicates(["segment_id"])
    words = lexicon(rows, most=most)
    shared = rows.sparkSession.sparkContext.broadcast(words.lex)
    texts = _with_forms(rows.filter("text is not null"), words, shared)
    got, heads = _scanned(texts, shared, choose=True)
    # Headers of a part, and hints on its words: pairs of words that are proper (n is null) or to choose from, with their count.
    hint, none = "struct<prev:string,word:string,n:bigint>", F.lit(None).cast("string")
    known = heads.select("segment_id", F.concat_ws("\x01", "key", "digits").alias("head"), F.lit(None).cast(hint).alias("hint"))
    context = got.filter("kind = 'context'").select("segment_id", F.col("key").alias("prev"), F.col("digits").alias("word")).join(words.alone, ["prev", "word"], "left_semi")
    known = known.unionByName(context.select("segment_id", none.alias("head"), F.struct("prev", "word", F.lit(None).cast("bigint").alias("n")).alias("hint")))
    choose = got.filter("kind = 'choose'").select("segment_id", F.col("key").alias("strokes"), F.col("digits").alias("word"))
    before = words.often.join(choose.select("word").distinct(), "word", "left_semi").withColumn("strokes", _strokes("prev"))
    known = known.unionByName(choose.join(before, ["strokes", "word"]).select("segment_id", none.alias("head"), F.struct("prev", "word", "n").alias("hint")))
    known = known.groupBy("segment_id").agg(F.collect_set("head").alias("heads"), F.collect_set("hint").alias("hints"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lex, out = _of_batch(shared.value, b["forms"]), []
            for seg, page, ordinal, t, heads, hints in b[["segment_id", "page", "ordinal", "text", "heads", "hints"]].itertuples(index=False):
                lines = t.split("\n")
                numbered, cand = edges(lines, _page(page, ordinal))
                known = set(heads) if heads is not None else set()
                heading = {i for i, ks in cand.items() if any(f"{key}\x01{digits}" in known for key, digits in ks)}
                alone = {i for i in numbered if i in heading or i not in cand}
                out += [(seg, *x) for x in repaired_lines(t, lex, frozenset(heading | alone), {(h["prev"], h["word"]): h["n"] for h in hints} if hints is not None else None)]
            yield pd.DataFrame(out, columns=["segment_id", "no", "line", "length"])

    whole = reflow(texts.join(known, "segment_id", "left").mapInPandas(run, "segment_id string, no int, line string, length int"))
    # Parts without any line left have an empty text.
    return rows.select("segment_id", F.col("text").isNotNull().alias("_has")).join(whole, "segment_id", "left").select("segment_id", F.when(F.col("_has"), F.coalesce("text", F.lit(""))).alias("text"))
