"""Variant spellings of names of people and organisations (problem 5)."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import checkpoint, partitions, spread

# Short forms of given names, titles, legal forms, and words that name nobody.
NICKNAMES = {
    "alexander": "alex sascha xander", "andreas": "andi andy", "benjamin": "ben benni benny", "christina": "tina chrissi chris christl", "concepción": "concha conchita",
    "cornelia": "conny nelly", "dorothea": "doro thea dora", "edward": "ed eddie ned ted", "elisabeth": "elsa lisbeth sissi lisa elli betty liesl", "francisco": "paco pancho fran curro",
    "françoise": "fanfan", "franziska": "franzi sissi", "friedrich": "fritz fred friedel", "gabriele": "gabi gaby", "gregory": "greg", "günther": "günni", "heinrich": "heiner heinz hein", "hildegard": "hilde gardi",
    "ignaz": "igi naz", "james": "jim jamie jimmy", "johannes": "hannes jo hans", "josé": "pepe zé", "josephine": "josi fine jo josie", "jürgen": "jürg", "katharina": "kathi kati käthe katja",
    "leopold": "poldi leo", "lukas": "luki luc", "margaret": "maggie peggy meg", "margarete": "grete gretel", "mathilde": "tilda hilde", "maximilian": "max maxi", "miriam": "mimi miri", "nikolaus": "niko klaus nick",
    "ottilie": "otti", "patricia": "patty pat trish", "philippa": "pippa", "quentin": "quen", "robert": "bob robbie rob bobby", "rosalía": "rosa lía", "samuel": "sam sami", "sebastian": "basti wastl bastian",
    "stefanie": "steffi", "susanne": "sanne susi", "theodor": "theo teddy", "tobias": "tobi", "ulrich": "uli ulli", "valentin": "valle val", "veronika": "vroni", "walburga": "burgi wally", "wilhelm": "willi willy helm", "william": "bill liam will billy",
    "yvonne": "yvi", "michael": "mike michi", "thomas": "tom", "matthias": "matze", "anna": "anni", "maria": "mia", "peter": "pit", "richard": "dick rick", "charles": "charlie", "anthony": "tony", "daniel": "dan dani", "david": "dave", "joseph": "joe sepp", "georg": "schorsch", "antonio": "toni", "manuel": "manolo", "jesús": "chus", "dolores": "lola",
}
TITLES = frozenset("herr herrn frau mr mrs ms miss mme mlle monsieur madame m dr prof sr sra señor señora don doña dipl ing hr fr".split())
LEGAL = {"gmbh", "ag", "kg", "eg", "se", "co", "ohg", "ug", "mbh", "gesellschaft", "aktiengesellschaft", "kommanditgesellschaft", "kommanditges", "genossenschaft", "eingetr", "eingetragene", "ltd", "inc", "sa", "sarl", "sl", "plc", "llc", "ev", "e.v.", "gbr"}
STRONG_LEGAL = LEGAL - {"co", "ev", "gesellschaft"}
COMPANY_PREFIX = frozenset(["fa", "firma", "company", "société", "empresa"])
NOBODY = frozenset(
    "unbekannt unknown kunde kundin mieter mieterin vermieter versicherungsnehmer versicherte customer client cliente locataire assuré konto n/a na null none admin gast guest user test root administrator info kontakt office familie fam eheleute erben inhaber empfänger sender absender patient arbeitnehmer".split()
)

#: Tokens whose roles (given name, surname, word of an organisation) the tasks know: the most frequent, seen three times or more.
#: Names with others are tried in both orders and as organisations, so none is lost for it.
MOST_TOKENS = 200_000
#: What writers do, as bits of a number, and the log likelihood of each ahead of its estimation from the names themselves.
TYPO, NICK, SHORT, INITIAL, LOGIN, ABBREVIATION, ORDER = (1 << i for i in range(7))
LIKELIHOOD = {TYPO: -3.0, NICK: -1.5, SHORT: -1.5, INITIAL: -2.0, LOGIN: -1.0, ABBREVIATION: -1.5, ORDER: -1.0}
_LIKELY = [sum(p for bit, p in LIKELIHOOD.items() if did & bit) for did in range(ORDER << 1)]
#: Log prior that a spelling which another form explains is a name of its own, and the least posterior of an attachment.
OWN, POSTERIOR = -5.0, 0.6
#: Share of a token's mentions that are one and the same typo of it, at most; mentions that each token is taken to have besides.
TYPO_RATE, BESIDES = 0.1, 16

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UMLAUT = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o"})


@lru_cache(maxsize=100_000)
def bare(text: str) -> str:
    """Lower case without accents, umlauts as the plain vowel."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_UMLAUT))
    return "".join(c for c in t if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    """bare, with the spellings of umlauts with e as the plain vowel too."""
    return bare(text).replace("ae", "a").replace("oe", "o").replace("ue", "u")


_SHORT: dict[str, list[str]] = {}
_NICKS: dict[str, list[str]] = {}
for _full, _list in NICKNAMES.items():
    _NICKS[fold(_full)] = [fold(x) for x in _list.split()]
    for _x in _NICKS[fold(_full)]:
        _SHORT.setdefault(_x, []).append(fold(_full))


class Roles:
    """How often tokens were seen as given name, surname and word of an organisation."""

    def __init__(self, counts: dict[str, tuple[int, int, int]]):
        self.counts = counts
        self.sectors: dict[str, list[str]] = {}
        for t in sorted(t for t, (g, s, o) in counts.items() if o > g + s and len(t) > 5):
            self.sectors.setdefault(t[0], []).append(t)

    def fold(self, word: str) -> str:
        """fold where that is a known token, else bare: in a typo, a and e may be neighbours by chance."""
        f, b = fold(word), bare(word)
        return f if f == b or all(p in self.counts or p in _NICKS or p in _SHORT for p in f.split("-")) else b

    def given(self, t: str) -> float:
        g, s, _ = self.counts.get(t, (0, 0, 0))
        return math.log((g + 0.5 + 5 * (t in _NICKS or t in _SHORT)) / (s + 0.5))

    def org(self, words: list[str]) -> bool:
        """Whether words were seen in organisations rather than in people's names."""
        seen = [self.counts.get(w, (0, 0, 0)) for w in words]
        return sum(o for _, _, o in seen) > sum(g + s for g, s, _ in seen)


def _legal(words: list[str]) -> bool:
    return any(w in STRONG_LEGAL for w in words)


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s,./&()-]+", text.lower()) if w]


def roles_of(name: str) -> list[tuple[str, str]]:
    """(token, role g, s or o) of the tokens of a name, as far as its own form shows them."""
    words = _words(name)
    if not words or words[0] in NOBODY or any(c.isdigit() or c == "@" for c in name):
        return []
    if _legal([fold(w) for w in words]) or words[0] in COMPANY_PREFIX:
        return [(fold(w), "o") for w in words if fold(w) not in LEGAL and w not in COMPANY_PREFIX and len(w) > 2]
    head, comma, tail = name.partition(",")
    person = lambda x: [fold(w) for w in x.split() if w.lower().rstrip(".") not in TITLES and len(w.rstrip(".")) > 1]
    if comma:
        a, b = person(head), person(tail)
        return [(a[0], "s"), (b[0], "g")] * 2 if len(a) == 1 and len(b) == 1 else []
    a = person(name)
    return [(a[0], "g"), (a[1], "s")] if len(a) == 2 else []


def parse(name: str, login: bool, roles: Roles) -> tuple[str, str, str]:
    """(kind, first, second): person (given, surname), initial (letter, surname), org (sorted words, ''), login (letters, ''), or none."""
    raw = name.strip()
    if not raw:
        return "none", "", ""
    if login or "@" in raw:
        local = raw.split("@", 1)[0].lower()
        stem = re.sub(r"\d+$", "", local)
        letters = fold(re.sub(r"[._+-]", "", stem))
        if re.fullmatch(r"kd[._-]?", stem) or stem in NOBODY or len(letters) < 4 or re.search(r"\d", letters):
            return "none", "", ""
        tokens = [fold(x) for x in re.split(r"[._]+", stem) if x]
        tokens = [fold(x) for x in stem.split("-")] if len(tokens) == 1 and stem.count("-") == 1 else tokens
        if len(tokens) == 2 and all(len(x) > 1 for x in tokens):
            a, b = tokens
            x, y = roles.given(a.split("-")[0]), roles.given(b.split("-")[0])
            if max(x, y) > 1 and abs(x - y) > 1.5:
                return ("person", a, b) if x > y else ("person", b, a)
        return "login", letters, ""
    words = _words(raw)
    if not words or words[0] in NOBODY or (words[0] == "the" and len(words) > 1) or re.search(r"\d", raw) or len(words) == 1 and words[0] in NOBODY:
        return "none", "", ""
    folded = [fold(w) for w in words]
    solid_words = [w for w, o in zip(folded, words) if w not in LEGAL and o not in COMPANY_PREFIX and w not in ("u", "und", "and", "et", "y") and not (len(w) == 1)]
    if _legal(folded) or words[0] in COMPANY_PREFIX or (solid_words and not any(w in _NICKS or w in _SHORT for w in solid_words) and roles.org(solid_words)):
        return ("org", "|".join(sorted(set(solid_words))), "") if solid_words else ("none", "", "")

    def clean(part: str) -> list[str]:
        return [w for w in part.split() if w.lower().rstrip(".") not in TITLES or w.lower() == "m." and len(raw.split()) == 2]

    head, comma, tail = raw.partition(",")
    tokens = [*clean(tail), "\0", *clean(head)] if comma else clean(raw)
    full = [roles.fold(w.strip(".")) for w in tokens if w != "\0"]
    marks = [i for i, w in enumerate(full) if len(w) == 1]
    solid = [w for w in full if len(w) > 1 and re.fullmatch(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", w)]
    if any(w in NOBODY for w in solid):
        return "none", "", ""
    if len(solid) == 1 and len(full) == 2 and marks:
        return "initial", full[marks[0]], solid[0]
    if len(solid) == 3:  # a double name without its hyphen
        x, y, z = solid
        solid = [f"{x}-{y}", z] if not comma and roles.given(y) > 1 > roles.given(z) else [x, f"{y}-{z}"] if comma or roles.given(x) > roles.given(z) else [z, f"{x}-{y}"]
    if len(solid) != 2:
        return "none", "", ""
    a, b = solid
    if not comma and roles.given(b.split("-")[0]) - roles.given(a.split("-")[0]) > 1.5:
        a, b = b, a
    return "person", a, b


def evidence(seen: int, other: int) -> float:
    """Log likelihood, 0 at most, that a token mentioned so often is a typo of one mentioned so often: repeated as often as no
    typo of it would be, it is a word of its own."""
    return 3 * min(0.0, math.log(TYPO_RATE * (other + BESIDES) / max(1, seen)))


def keys_of(kind: str, a: str, b: str, roles: Roles, near: dict[str, list[tuple[str, float]]]) -> Iterator[tuple[str, int, float, bool, bool]]:
    """(key, what the writer did, further log likelihood, as variant, as canonical form) under which a name meets the names of
    its vault. near: by token what it may be a typo of, with the evidence."""
    if kind == "person":
        fulls = _SHORT.get(a, [])
        g1, s1 = a.split("-")[0], b.split("-")[0]
        yield f"E{a}|{b}", 0, 0.0, True, True
        for f in fulls:
            yield f"E{f}|{b}", NICK, 0.0, True, False
        for g, s in {(g1, b), (a, s1), (g1, s1)} - {(a, b)}:
            yield f"E{g}|{s}", SHORT, 0.0, False, True
        for c, e in near.get(a, ()):
            yield f"E{c}|{b}", TYPO, e, True, False
        for c, e in near.get(b, ()):
            yield f"E{a}|{c}", TYPO, e, True, False
            for f in fulls:
                yield f"E{f}|{c}", TYPO | NICK, e, True, False
        unknown = a not in roles.counts and b not in roles.counts
        if unknown or abs(roles.given(g1) - roles.given(s1)) <= 1.5:
            yield f"E{b}|{a}", ORDER, 0.0, True, False
        if unknown:
            yield "O" + "|".join(sorted({a, b})), ORDER, 0.0, True, False
        # The same letters may come as a login, cut into names in another place.
        yield "U" + (a + b).replace("-", ""), 0, 0.0, True, True
        yield f"I{a[0]}|{b}", 0, 0.0, False, True
        if s1 != b:
            yield f"I{a[0]}|{s1}", SHORT, 0.0, False, True
        givens = {a.replace("-", ""): 0, a[0]: INITIAL, **{n: NICK for n in _NICKS.get(a, [])}}
        if g1 != a:
            givens[g1] = SHORT
        for (g, did), s in product(givens.items(), {b.replace("-", ""), s1}):
            did |= LOGIN | (SHORT if s != b.replace("-", "") else 0)
            yield f"U{g}{s}", did, 0.0, False, True
            yield f"U{s}{g}", did, 0.0, False, True
    elif kind == "initial":
        yield f"I{a}|{b}", INITIAL, 0.0, True, False
        for c, e in near.get(b, ()):
            yield f"I{a}|{c}", INITIAL | TYPO, e, True, False
    elif kind == "login":
        yield f"U{a}", 0, 0.0, True, False
    elif kind == "org":
        words = a.split("|")
        yield f"O{a}", 0, 0.0, True, True
        for i, w in enumerate(words):
            rest = [*words[:i], *words[i + 1 :]]
            for c, e in near.get(w, ()):
                yield "O" + "|".join(sorted({*rest, c})), TYPO, e, True, False
            if len(words) > 1:
                for t in roles.sectors.get(w[0], ()):
                    if t != w and abbreviates(w, t):
                        yield "O" + "|".join(sorted({*rest, t})), ABBREVIATION, 0.0, True, False


def abbreviates(short: str, full: str) -> bool:
    """Whether letters of the full word in order, its first ahead, make the short one; or, for near spellings, the other way round."""
    if short[0] != full[0] or short == full:
        return False
    if len(short) > len(full):
        return len(short) - len(full) <= 4 and len(full) >= 6 and short[-1] == full[-1] and _inside(full, short) or short[:-1] == full
    if len(short) > 4 and not full.startswith(short[:5]):
        return False
    return len(short) < len(full) - 1 and _inside(short, full)


def _inside(a: str, b: str) -> bool:
    it = iter(b)
    return all(c in it for c in a)


def roles(names: DataFrame) -> Roles:
    """Roles of tokens over all names, counted in the tasks ahead of the shuffle; at most MOST_TOKENS reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame([(t, r, n) for (t, r), n in c.items()], columns=["token", "role", "n"])

        for b in batches:
            for name, login in zip(b["name"], b["login"]):
                if not login:
                    c.update(roles_of(name))
            if len(c) > 200_000:
                yield out()
                c.clear()
        yield out()

    got = names.select("name", "login").mapInPandas(count, "token string, role string, n long")
    one = lambda r: F.sum(F.when(F.col("role") == r, F.col("n")).otherwise(0)).alias(r)
    got = got.groupBy("token").agg(one("g"), one("s"), one("o"), F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "token").limit(MOST_TOKENS)
    return Roles({r["token"]: (r["g"], r["s"], r["o"]) for r in got.toLocalIterator()})


def spellings(classifications: DataFrame, facts: DataFrame, logins: DataFrame) -> DataFrame:
    """vault, name, login, n: every string of the three columns of each vault, once."""
    a = classifications.select("vault", F.col("subject_name").alias("name"), F.lit(False).alias("login"))
    b = facts.select("vault", F.col("subject_quote").alias("name"), F.lit(False).alias("login"))
    c = logins.select("vault", F.col("username").alias("name"), F.lit(True).alias("login"))
    rows = a.unionByName(b).unionByName(c).filter("vault is not null and name is not null and trim(name) <> ''")
    return rows.groupBy("vault", "name").agg(F.min("login").alias("login"), F.count("*").alias("n"))


def _near(tokens: DataFrame) -> DataFrame:
    """role, token, seen, near (tokens mentioned as often or more, of one letter more, less or other, or two swapped, with their
    mentions). A join of distinct tokens on what is left of each without one of its letters."""
    stats = checkpoint(tokens.groupBy("role", "token").agg(F.sum("n").alias("seen"), F.count("*").alias("nodes")))
    less = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, F.length("token"))))
    cuts = F.when(F.length("token") > 2, F.array_distinct(F.concat(F.array("token"), less))).otherwise(F.array("token"))
    left = stats.select("role", "token", "seen", F.explode(cuts).alias("cut"))
    other = left.select("role", "cut", F.col("token").alias("other"), F.col("seen").alias("mentions"))
    met = left.join(other, ["role", "cut"]).filter((F.col("token") != F.col("other")) & (F.col("mentions") >= F.col("seen")))
    met = met.groupBy("role", "token").agg(F.collect_set(F.struct("other", "mentions")).alias("near"))
    return stats.join(met, ["role", "token"], "left")


def _likelihood(did: Column, of: dict[int, float]) -> Column:
    return sum((F.when(did.bitwiseAND(bit) != 0, x).otherwise(0.0) for bit, x in of.items()), F.lit(0.0))


def _posterior(met: DataFrame, of: dict[int, float]) -> DataFrame:
    """v, c, own, posterior of the best explanation of each spelling that another form explains, against all others and itself.
    A candidate may be a variant itself (a nickname with a typo, a short double name): candidates that lead to one form, by
    the best explanation of each, share their weight."""
    scored = met.withColumn("score", F.col("cprior") + F.col("more") + _likelihood(F.col("did"), of))
    best = scored.groupBy("v").agg(F.max(F.struct("score", "c")).alias("m"), F.first("vprior").alias("own")).filter(F.col("m.score") > F.col("own") + OWN)
    roots = _ends(best.select("v", "m.c", "own")).withColumnRenamed("v", "c")
    at = scored.join(roots, "c", "left").withColumn("root", F.coalesce("entity", "c"))
    at = at.groupBy("v", "root").agg(F.max(F.struct("score", "c", "did")).alias("m"), F.sum(F.exp("score")).alias("weight"), F.first("vprior").alias("own"))
    g = at.groupBy("v").agg(F.max(F.struct("weight", "m")).alias("b"), F.sum("weight").alias("z"), F.first("own").alias("own"))
    return g.select("v", "b.m.c", "own", (F.col("b.weight") / (F.col("z") + F.exp(F.col("own") + OWN))).alias("posterior")).filter(F.col("posterior") >= POSTERIOR)


def _ends(links: DataFrame) -> DataFrame:
    """v, entity: links (v to c, one each, own: the prior of v) followed to where they end, over any number of steps, by pointer
    doubling. Of two forms that lead to each other the one of greater prior is the end; of longer rings the least form."""
    back = links.select(F.col("c").alias("v"), F.col("v").alias("c"), F.col("own").alias("other"))
    first = links.join(back, ["v", "c"], "left").filter(F.col("other").isNull() | (F.struct("own", "v") < F.struct(F.col("other").alias("own"), F.col("c").alias("v"))))
    at, steps = checkpoint(first.select("v", F.col("c").alias("to"), F.least("v", "c").alias("low"))), 1
    while True:
        step = at.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("low").alias("below"))
        at = checkpoint(at.join(step, "to", "left").select("v", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("below", "low")).alias("low"), F.col("next").isNotNull().alias("on")))
        steps, on = steps * 2, at.filter("on").count()
        # What goes on is on the way to an end, and fewer each time, or in a ring that as many steps as forms go round.
        if on == 0 or steps > 2 * on:
            break
        at = at.drop("on")
    if not on:
        return at.select("v", F.col("to").alias("entity"))
    ring = at.select(F.col("v").alias("to"), F.col("low").alias("ring"))
    return at.join(ring, "to", "left").select("v", F.coalesce("ring", "to").alias("entity"))


def entities(names: DataFrame) -> DataFrame:
    """vault, name, entity, kind, posterior: each spelling that means a person or organisation, with the canonical form it is attached to.

    A noisy channel: spellings are read as given name and surname, initial and surname, words of an organisation or letters of
    a login (titles, legal forms, case, accents, order and middle initials do not count). Readings met in full are candidate
    canonical forms, ranked by frequency in the vault and of their tokens in all vaults. Every reading meets candidates of its
    vault under keys: its own, its full form of a nickname, parts of double names, what its rare tokens may be typos of, its
    abbreviations; and is attached to the one of the greatest posterior, if that is at least POSTERIOR. The posterior weighs
    prior times likelihood of all candidates and of the spelling being a name of its own. The likelihood of what writers do
    is estimated: with first values, how many of the forms that could be written so are found to be. Links are followed to their ends.

    All joins are on the vault and a key, or on distinct tokens, so no vault and no family is collected. Null, blank and
    nobody's names (roles, placeholders, families) are left out.
    """
    names = checkpoint(names)
    spark = names.sparkSession
    shared = spark.sparkContext.broadcast(roles(names))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(v, n, k, *parse(n, lo, shared.value)) for v, n, lo, k in zip(b["vault"], b["name"], b["login"], b["n"])]
            yield pd.DataFrame([x for x in out if x[3] != "none"], columns=["vault", "name", "n", "kind", "a", "b"])

    read_names = spread(names, "vault", "name").mapInPandas(read, "vault string, name string, n long, kind string, a string, b string")
    read_names = checkpoint(read_names.withColumn("node", F.xxhash64("vault", "kind", "a", "b")))
    nodes = read_names.groupBy("node").agg(F.first("vault").alias("vault"), F.first("kind").alias("kind"), F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").alias("n"))
    nodes = checkpoint(nodes)
    role = lambda r, c: F.struct(F.lit(r).alias("role"), F.col(c).alias("token"))
    of_kind = F.when(F.col("kind") == "person", F.array(role("g", "a"), role("s", "b"))).when(F.col("kind") == "initial", F.array(role("s", "b")))
    of_kind = of_kind.when(F.col("kind") == "org", F.transform(F.split("a", "\\|"), lambda w: F.struct(F.lit("o").alias("role"), w.alias("token"))))
    tokens = nodes.select("node", "n", F.explode(of_kind).alias("t")).select("node", "n", "t.role", "t.token")
    facts = F.struct("role", "token", "seen", "nodes", "near")
    told = nodes.join(tokens.drop("n").join(_near(tokens), ["role", "token"]).groupBy("node").agg(F.collect_list(facts).alias("tokens")), "node", "left")

    def spread_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for node, vault, kind, a, b, n, known in zip(x["node"], x["vault"], x["kind"], x["a"], x["b"], x["n"], x["tokens"]):
                near, common = {}, 1.0
                for t in known if known is not None else ():
                    near[t["token"]] = [(o["other"], evidence(t["seen"], o["mentions"])) for o in (t["near"] if t["near"] is not None else ())]
                    common *= t["nodes"]
                prior = math.log(n + 1.0) + 0.3 * math.log(common + 1.0)
                best: dict[tuple[str, bool, bool], tuple[float, int, float]] = {}
                for key, did, more, var, can in keys_of(kind, a, b, shared.value, near):
                    k, p = (key, var, can), more + _LIKELY[did]
                    if k not in best or best[k][0] < p:
                        best[k] = (p, did, more)
                out += [(node, vault + "\0" + key, prior, did, more, var, can) for (key, var, can), (_, did, more) in best.items()]
            yield pd.DataFrame(out, columns=["node", "key", "prior", "did", "more", "variant", "canonical"])

    keyed = told.repartition(partitions(spark), "node").mapInPandas(spread_keys, "node long, key string, prior double, did int, more double, variant boolean, canonical boolean")
    keyed = checkpoint(keyed.withColumn("key", F.xxhash64("key")))
    v = keyed.filter("variant").select("key", F.col("node").alias("v"), F.col("prior").alias("vprior"), F.col("did").alias("dv"), F.col("more").alias("more"))
    c = keyed.filter("canonical").select("key", F.col("node").alias("c"), F.col("prior").alias("cprior"), F.col("did").alias("dc"))
    met = v.join(c, "key").filter("v <> c").withColumn("did", F.col("dv").bitwiseOR(F.col("dc")))
    best = F.max(F.struct((F.col("more") + _likelihood(F.col("did"), LIKELIHOOD)).alias("p"), "did", "more", "vprior", "cprior")).alias("m")
    met = checkpoint(met.groupBy("v", "c").agg(best).select("v", "c", "m.did", "m.more", "m.vprior", "m.cprior"))
    first = met.groupBy("v").agg(F.max(F.struct((F.col("cprior") + F.col("more") + _likelihood(F.col("did"), LIKELIHOOD)).alias("score"), "c", "did")).alias("m"), F.first("vprior").alias("own"))
    seen = first.filter(F.col("m.score") > F.col("own") + OWN).select("m.did").agg(*[F.sum((F.col("did").bitwiseAND(bit) != 0).cast("long")).alias(f"d{bit}") for bit in LIKELIHOOD]).first()
    person, org = F.col("kind") == "person", F.col("kind") == "org"
    fits = {SHORT: person & (F.col("a").contains("-") | F.col("b").contains("-")), NICK: person & F.col("a").isin([*_NICKS, *_SHORT]), ABBREVIATION: org, TYPO: person | org}
    could = nodes.agg(*[F.sum(fits.get(bit, person).cast("long")).alias(f"d{bit}") for bit in LIKELIHOOD]).first()
    # Of the forms that could be written so, how many are; with few, the first values stand: each counts as ten forms.
    estimated = {bit: math.log(((seen[f"d{bit}"] or 0) + 10 * math.exp(p)) / ((could[f"d{bit}"] or 0) + (seen[f"d{bit}"] or 0) + 10)) for bit, p in LIKELIHOOD.items()}
    pick = checkpoint(_posterior(met, estimated))
    ends = _ends(pick).join(pick.select("v", "posterior"), "v").withColumnRenamed("v", "node")
    linked = read_names.select("vault", "name", "kind", "node").join(ends, "node", "left").filter("kind in ('person', 'org') or entity is not null")
    return linked.select("vault", "name", F.coalesce("entity", "node").alias("entity"), "kind", F.coalesce("posterior", F.lit(1.0)).alias("posterior"))


def pairs(linked: DataFrame) -> DataFrame:
    """vault, name_a, name_b (smaller first): pairs of different strings of one entity."""
    linked = checkpoint(linked)
    a = linked.select("vault", "entity", F.col("name").alias("name_a"))
    b = linked.select("vault", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["vault", "entity"]).filter("name_a < name_b").select("vault", "name_a", "name_b").distinct()
