"""Text decoded with the wrong character encoding: finding and restoring it (problem 4)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The ordinary characters of German, English, French and Spanish text and common signs; words by which a
# text's language shows; encodings that text is wrongly read with.
LETTERS = "äöüÄÖÜßéèêëàâçñóúíáîïôûùœæÉÈÀÇÊÂÔÎÛÚÓÁÍÑŒ"
SIGNS = "€£§°²³·–—’‘“”„«»…¿¡ªº¼½¾±×÷µØ√≤≥≈•‐­  ¬©®™"
COMMON = "äöüÄÖÜßéèêàâçñóúíáîôûœÉÀ€²³°§’–‐¬­"
LANGUAGES = {
    "de": ("der", "die", "und", "wird", "ist", "sie", "von", "den", "für", "bitte", "mit", "ihre"),
    "en": ("the", "of", "and", "is", "your", "for", "will", "please", "with", "to"),
    "fr": ("le", "la", "les", "des", "vous", "est", "de", "du", "une", "votre", "sera", "à"),
    "es": ("el", "los", "las", "de", "del", "su", "por", "una", "se", "que", "en", "para"),
}
WIDE = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "cp1254", "cp866", "koi8-r")
NARROW = ("mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-2", "iso8859-7", "koi8-r", "cp866")

#: Bytes of each language's dictionary, entries taken into it, and least count of an entry.
DICTIONARY_BYTES, ENTRIES, LEAST = 65_536, 6_000, 3
#: Cost in bits of applying one step of a chain, and of each change the step makes.
STEP_BITS, CHANGE_BITS = 7.0, 1.0
#: Bits of an entry of the dictionary: its number among at most 2^13.
ENTRY_BITS = 13.0
#: Distinct tokens a task counts before it hands them on.
FLUSH = 200_000

_PLAIN = re.compile(f"[\\x20-\\x7e{re.escape(LETTERS + SIGNS)}]+")
_INNER = re.compile("[a-zäöüßéèêàâçñóúíáîôû][ÄÖÜÉÈÀÇÊÂÔÎÛÚÓÁÍÑ]")
_DIGIT = re.compile("[0-9]")
_MARKS = re.compile("[.,;:!?()\"„“”]+$")
_LOST = "�"
_SPLIT = re.compile("([ \\t\\r\\n]+)")
_MEANT = frozenset(LETTERS + SIGNS + "ãõÃÕåøÅØ")
_GARBLED = frozenset(bytes(range(0x80, 0x100)).decode("latin-1") + "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ√∂∫≈≤≥˙˝˛ˇ")


def _byte_chars(encoding: str) -> dict[str, int]:
    """Character -> byte of the upper half; bytes the encoding leaves out stand as control characters, as browsers read them."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


@lru_cache(maxsize=None)
def _wide(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """What UTF-8 sequences look like when read with an encoding."""
    chars = _byte_chars(encoding)
    by = {b: re.escape(c) for c, b in chars.items()}
    tail = "[" + "".join(by[b] for b in range(0x80, 0xC0)) + "]"
    lead = lambda a, b: "[" + "".join(by[x] for x in range(a, b)) + "]"
    return re.compile(f"{lead(0xC2, 0xE0)}{tail}|{lead(0xE0, 0xF0)}{tail}{{2}}|{lead(0xF0, 0xF5)}{tail}{{3}}"), chars


def _ordinary(c: str) -> bool:
    """Whether a restored character can be meant: the ordinary ones, and Latin and Cyrillic letters of neighbours' names."""
    return c in _MEANT or "\u0100" <= c <= "\u017f" or "\u0400" <= c <= "\u045f"


def _undo_wide(text: str, encoding: str) -> str:
    find, chars = _wide(encoding)

    def back(m: re.Match) -> str:
        try:
            out = bytes(chars[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        return out if all(map(_ordinary, out)) or all(c in _GARBLED for c in out) else m.group()

    return find.sub(back, text)


@lru_cache(maxsize=None)
def _narrow(encoding: str) -> dict[int, str]:
    """Translation of what cp1252 bytes look like when read with another one-byte encoding; only towards ordinary letters and signs."""
    out = {}
    for c, b in _byte_chars(encoding).items():
        try:
            right = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            continue
        if right != c and c not in "€–¬\xad" and right in LETTERS + "€’–²³°§":
            out[ord(c)] = right
    return out


def _suspect() -> str:
    """Rows that may hold damage: any character outside the common ones, any that a one-byte step changes, any two that may
    begin a sequence of UTF-8, a capital within a word. It holds for every text that some chain changes."""
    one = {chr(c) for e in NARROW for c in _narrow(e)} & set(COMMON)
    two = []
    for e in WIDE:
        chars = {c: b for c, b in _byte_chars(e).items() if c in COMMON}
        lead, tail = ("".join(c for c, b in chars.items() if lo <= b < hi) for lo, hi in ((0xC2, 0xF5), (0x80, 0xC0)))
        if lead and tail:
            two.append(f"[{lead}][{tail}]")
    return "|".join([f"[^\\x00-\\x7f{COMMON}]", f"[{''.join(sorted(one))}]", *dict.fromkeys(two), "[a-zäöü][ÉÀÄÖÜ]"])


#: Matched in the JVM; the judge decides about the rows.
SUSPECT = _suspect()


def chains(token: str) -> dict[tuple[str, ...], str]:
    """Every chain of up to three wrong steps that changes a token, and what comes out."""
    out: dict[tuple[str, ...], str] = {}
    seen, front = {token}, [((), token)]
    for _ in range(3):
        back = []
        for chain, t in front:
            for e in WIDE:
                u = _undo_wide(t, e)
                if u != t and u not in seen:
                    back.append(((*chain, e + ">utf-8"), u))
        seen.update(u for _, u in back)
        out.update(back)
        front = back
        if not front:
            break
    for e in NARROW:
        u = token.translate(_narrow(e))
        if u != token:
            out[(e + ">cp1252",)] = u
    return {c: u for c, u in out.items() if all(x < "\x80" or _ordinary(x) or x in token for x in u)}


def masked(word: str) -> str:
    return _MARKS.sub("", _DIGIT.sub("0", word))


def tokens_of(text: str) -> list[str]:
    """The words of a text that hold a character beyond ASCII, digits as 0, without closing marks."""
    return [masked(w) for w in text.split() if not w.isascii()]


def language(text: str) -> str:
    """The language whose common words occur most; the first of the list in ties."""
    words = Counter(text.lower().split())
    return max(LANGUAGES, key=lambda k: sum(words[w] for w in LANGUAGES[k]))


def dictionary_entries(texts: DataFrame, text: str) -> DataFrame:
    """lang, token, n: tokens beyond ASCII of all texts, counted in the tasks ahead of the shuffle; only tokens of ordinary characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(k, t, n) for (k, t), n in c.items()], columns=["lang", "token", "n"])

        for b in batches:
            for t in b[text]:
                if t:
                    toks = tokens_of(t)
                    if toks:
                        k = language(t)
                        for w in toks:
                            c[k, w] += 1
            if len(c) > FLUSH:
                yield out()
                c.clear()
        yield out()

    got = texts.select(text).filter(F.col(text).isNotNull()).mapInPandas(count, "lang string, token string, n long")
    return got.groupBy("lang", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def dictionaries(entries: DataFrame) -> dict[str, bytes]:
    """Per language the dictionary's bytes: the ENTRIES most frequent tokens, the most frequent last, where zstandard finds
    them cheapest. Its size is bounded by DICTIONARY_BYTES, however large the corpus."""
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.desc("n"), "token")
    rows = [(r["lang"], r["token"], r["n"]) for r in entries.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= ENTRIES).orderBy("lang", "rn").collect()]
    return select_entries(rows)


def select_entries(rows: list[tuple[str, str, int]]) -> dict[str, bytes]:
    """The dictionaries from (lang, token, n), most frequent first: tokens of ordinary characters that are not themselves
    damaged, that is, which no chain turns into a far more frequent token."""
    n_of: Counter = Counter()
    for _, t, n in rows:
        n_of[t] += n
    kept: dict[str, list[str]] = {k: [] for k in LANGUAGES}
    for k, t, n in rows:
        if _PLAIN.fullmatch(t) and not _INNER.search(t) and not any(n_of[u] >= 10 * n for u in chains(t).values()):
            kept[k].append(t)
    out = {}
    for k, ts in kept.items():
        b = ("\n".join(reversed(ts)) + "\n").encode()
        # Cut between tokens: what is left of one would be a token of its own.
        out[k] = b if len(b) <= DICTIONARY_BYTES else b[-DICTIONARY_BYTES:].partition(b"\n")[2]
    return out


class Judge:
    """Chooses the chain of least description length under per-language zstandard dictionaries."""

    def __init__(self, dicts: dict[str, bytes]):
        import zstandard as z

        self.z = {}
        params = z.ZstdCompressionParameters.from_level(3, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=3, strategy=z.STRATEGY_BTOPT)
        for k, b in dicts.items():
            d = z.ZstdCompressionDict(b, dict_type=z.DICT_TYPE_RAWCONTENT) if len(b) > 8 else None
            if d is not None:
                d.precompute_compress(compression_params=params)
            self.z[k] = z.ZstdCompressor(compression_params=params, dict_data=d)
        self.known = {k: set(b.decode("utf-8", "ignore").split("\n")) for k, b in dicts.items()}
        self.anywhere = set().union(*self.known.values())
        self.gain_of: dict[tuple[str, str], dict[tuple[str, ...], float]] = {}

    def bits(self, lang: str, token: str) -> float:
        """Bits of a masked token: an entry's number if the dictionaries hold it, else what zstandard makes of it. Three copies,
        for it stores anything shorter raw."""
        if token in self.known[lang]:
            return ENTRY_BITS
        if token in self.anywhere:
            return ENTRY_BITS + 2.0
        return 8.0 * len(self.z[lang].compress((("\n" + token) * 3 + "\n").encode("utf-8", "replace")))

    def gains(self, lang: str, token: str) -> dict[tuple[str, ...], float]:
        """Bits that each chain saves on a masked token; only chains that save."""
        got = self.gain_of.get((lang, token))
        if got is None:
            if len(self.gain_of) > 100_000:
                self.gain_of.clear()
            got, options = {}, {} if token in self.anywhere else chains(token)
            if options:
                was = self.bits(lang, token)
                got = {c: g for c, u in options.items() if (g := was - self.bits(lang, u) - CHANGE_BITS) > 0}
            self.gain_of[lang, token] = got
        return got

    def sure(self, token: str, chain: tuple[str, ...]) -> bool:
        """Whether a chain speaks for itself on a masked token: not if it only puts small ordinary letters for others ('Auß' as
        'Auá') or a § after a letter, and no dictionary holds the outcome; such words follow a chain that other words call for."""
        u = _apply(token, chain)
        if u in self.anywhere or len(u) != len(token):
            return True
        swaps = [(i, x, y) for i, (x, y) in enumerate(zip(token, u)) if x != y]
        return not all(x in LETTERS and x.islower() and (y in LETTERS and y.islower() or y == "§" and token[:i][-1:].isalpha()) for i, x, y in swaps)

    def judge(self, text: str) -> tuple[tuple[str, ...], str] | None:
        """(chains, restored text) if chains describe the text shorter than the text itself, or nothing. A chain is applied to
        the words that it shortens; after the best chain others may follow for the words it left."""
        pieces = _SPLIT.split(text)
        at = [i for i in range(0, len(pieces), 2) if not pieces[i].isascii()]
        lang, taken = language(text), []
        while at:
            total: Counter = Counter()
            each = {i: self.gains(lang, masked(pieces[i])) for i in at}
            for i, g in each.items():
                total.update({c: x for c, x in g.items() if self.sure(masked(pieces[i]), c)})
            if not total:
                break
            chain = min(total, key=lambda c: (STEP_BITS * len(c) - total[c], len(c), c))
            if total[chain] <= STEP_BITS * len(chain):
                break
            for i in at:
                if chain in each[i]:
                    pieces[i] = _apply(pieces[i], chain)
            at = [i for i in at if chain not in each[i]]
            taken.append("+".join(chain))
        return (tuple(taken), "".join(pieces)) if taken else None


def _apply(word: str, chain: tuple[str, ...]) -> str:
    for step in chain:
        e, _, to = step.partition(">")
        word = _undo_wide(word, e) if to == "utf-8" else word.translate(_narrow(e))
    return word


def repair_lost(text: str, judge: Judge) -> str:
    """Words with lost characters (U+FFFD) completed where exactly one frequent word of the language fits."""
    known = judge.known[language(text)]

    def fix(m: re.Match) -> str:
        w = m.group()
        core = _MARKS.sub("", w)
        if core.strip(_LOST) == "" or len(core) < 3:
            return w
        find = re.compile(re.escape(core).replace(_LOST, "[^\\x00-\\x7f]"))
        hits = [k for k in known if len(k) == len(core) and find.fullmatch(k)]
        return hits[0] + w[len(core) :] if len(hits) == 1 else w

    return re.sub(r"\S*" + _LOST + r"\S*", fix, text)


def wrong_encodings(rows: DataFrame, text: str, keys: tuple[str, ...], dicts: dict[str, bytes]) -> DataFrame:
    """keys, chain, restored of each row whose text holds text decoded with the wrong encoding.

    Rows that hold nothing a chain could change are dismissed in the JVM. For the others every candidate decoding of each word (chains of up to
    three wrong steps) is compressed with the dictionary of the text's language; the chain of least description length, its
    own cost included, is taken, and none if the text itself is shortest. Damage in places is undone in those places only.
    A text with U+FFFD has lost characters: chain 'lost', completed where one frequent word fits, else left. Null and empty
    texts are no cases. Rows repeated in keys and text come once. dicts is broadcast; its size is bounded.
    """
    cand = rows.select(*keys, text).filter(F.col(text).rlike(SUSPECT)).dropDuplicates([*keys, text])
    shared = rows.sparkSession.sparkContext.broadcast(dicts)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", chain string, restored string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = Judge(shared.value)
        for b in batches:
            out = []
            for *key, t in b.itertuples(index=False):
                got = j.judge(t)
                chain, now = (" ".join(got[0]), got[1]) if got else ("", t)
                if _LOST in now:
                    chain, now = (chain + " lost").lstrip(), repair_lost(now, j)
                if chain:
                    out.append((*key, chain, now))
            yield pd.DataFrame(out, columns=[*keys, "chain", "restored"])

    return cand.mapInPandas(run, schema)


def found(parts: DataFrame, facts: DataFrame) -> DataFrame:
    """record_kind, record_id, chain, restored of damaged parts and quotes; the dictionaries come from the parts."""
    dicts = dictionaries(dictionary_entries(parts, "text"))
    p = wrong_encodings(parts.filter("segment_id is not null"), "text", ("segment_id",), dicts)
    q = wrong_encodings(facts.filter("fact_id is not null"), "quote", ("fact_id",), dicts)
    both = p.select(F.lit("part").alias("record_kind"), F.col("segment_id").alias("record_id"), "chain", "restored")
    return both.unionByName(q.select(F.lit("fact").alias("record_kind"), F.col("fact_id").cast("string").alias("record_id"), "chain", "restored"))
