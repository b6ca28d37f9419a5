"""Abusive, hateful or sexual content by multiple-instance learning (problem 8)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.tables import spread

HEADS = ("abusive", "hateful", "sexual")
#: Feature space, and the most labelled documents a model is fitted on (those of the least hash of their id) with the most
#: bytes of their features.
BITS, MOST_LABELLED, MOST_BYTES = 17, 8_000, 1 << 26
_MASK = (1 << BITS) - 1
#: Labelled cases a feature must come in to have a weight: what a single document holds is its own names and amounts.
SUPPORT = 2
#: Out-of-fold probabilities beyond which a label against them counts as wrong and is left out of the last fit, by the share
#: of labelled cases that the folds find: a model that misses most labels says nothing about the labels.
SURE = ((0.75, 0.1), (0.5, 0.03))
#: What every sentence has without being a case; without it, thousands of harmless sentences would add up to one.
LEAK = 0.02
#: Range of the threshold, which maximises F1 out of fold.
THRESHOLDS = tuple(x / 100 for x in range(30, 76, 5))
#: Longest stretch without a sentence end that is one sentence; the next begins this much before its cut, so no phrase is cut.
LONGEST, OVERLAP = 600, 80

# Characters that hide nothing but words, letters of other scripts that look Latin, signs that stand for letters.
_HIDDEN = dict.fromkeys(map(ord, "​‌‍⁠﻿­᠎︎️‎‏"))
_LOOKALIKE = str.maketrans("аеорсухіјѕԁһмткнвɡοαετικνρυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТХ", "aeopcyxijsdhmtkhbgoaetiknpuxabezhikmnoptyxabekmhopctx")
_LEET = str.maketrans("0134578@$!|€", "oieastbasiie")
_LEET_WORD = re.compile(r"(?<![^\W_])(?=\S*[^\W\d_])(?=\S*[\d@$!|€])[^\W_@$!|€]*[\d@$!|€][\w@$!|€]*[^\W_]")
_SPREAD = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*·•| ][^\W\d_]){3,}(?![^\W_])")
_STAR = re.compile(r"(?<=[^\W\d_])[*#]+(?=[^\W\d_])")
_AGAIN = re.compile(r"([^\W\d_])\1{2,}")
# Only texts with one of these can change: a letter between marks or blanks, a digit or sign by a letter, a letter thrice.
_SUSPECT = re.compile(r"(?<![^\W_])[^\W\d_][.\-_*·•| ][^\W\d_](?![^\W_])|[^\W\d_][\d@$!|€*#]|[\d@$!|€][^\W\d_]|([^\W\d_])\1\1")
_HIDDEN_ALIKE = {**_HIDDEN, **_LOOKALIKE}
_HAS_HIDDEN_ALIKE = re.compile("[" + "".join(re.escape(chr(c)) for c in _HIDDEN_ALIKE) + "]")
_NUMBERS = re.compile(r"(?<!\w)\d+(?!\w)")
_DIGITS = re.compile(r"\d")
_marks = lambda a, z: re.compile("[" + "".join(chr(c) for c in range(a, z) if unicodedata.combining(chr(c))) + "]+")
# Combining marks; those beyond the first plane apart, as a class of both is searched far more slowly.
_MARKS, _FAR_MARKS, _FAR = _marks(0x300, 0x10000), _marks(0x10000, 0x20000), re.compile("[\U00010000-\U0010ffff]")
_ENDS = re.compile(r"(?<=[.!?…])[\"'»“”)]*\s+|\n+")
_SPEAKER = re.compile(r"^\s*(?:\[[^\]]{1,12}\]\s*)?(?:[A-ZÄÖÜÉ][\w-]{1,30}:\s+)?")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[!?]+|[\"„“”«»]")


def plain(text: str) -> str:
    """A text without disguise: compatible forms, hidden characters, look-alikes, spread letters, digits for letters and
    repeated letters undone; lower case without accents."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        t = t.translate(_HIDDEN_ALIKE) if _HAS_HIDDEN_ALIKE.search(t) else t
    if _SUSPECT.search(t):
        t = _SPREAD.sub(lambda m: re.sub(r"[.\-_*·•| ]", "", m.group()), t)
        t = _LEET_WORD.sub(lambda m: m.group().translate(_LEET) if sum(c.isalpha() for c in m.group()) * 5 >= len(m.group()) * 2 else m.group(), t)
        t = _STAR.sub("", _AGAIN.sub(r"\1\1", t))
    t = t.lower()
    if t.isascii():
        return t
    t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
    return _FAR_MARKS.sub("", t) if _FAR.search(t) else t


def sentences(text: str) -> list[str]:
    """A text's sentences; lines end sentences, and a stretch without an end is cut at blanks into pieces of at most LONGEST
    that overlap by about OVERLAP."""
    out = []
    for s in _ENDS.split(text):
        s = s.strip()
        while len(s) > LONGEST:
            cut = s.rfind(" ", 0, LONGEST)
            cut = cut if cut > 0 else LONGEST
            out.append(s[:cut])
            back = s.rfind(" ", cut // 2, max(cut // 2, cut - OVERLAP))
            s = s[back if back > 0 else cut - OVERLAP if s[cut] != " " else cut :].strip()
        if s:
            out.append(s)
    return out


def _hash(name: str) -> int:
    return crc32(name.encode()) & _MASK


@lru_cache(maxsize=100_000)
def _word_features(x: str) -> tuple[int, ...]:
    """Of a word: itself, its letters sorted (typos swap letters), and every five letters in a row."""
    out = [_hash(f"w{x}")]
    if len(x) > 4:
        y = f"<{x}>"
        out.append(_hash("a" + "".join(sorted(x))))
        out += [_hash(f"c{y[i : i + 5]}") for i in range(len(y) - 4)]
    return tuple(out)


def features(sentence: str) -> np.ndarray:
    """Hashed words, pairs and near pairs of words, and letters of words; each once."""
    body = _SPEAKER.sub("", sentence, count=1)
    w = [x if x.isalpha() or not _DIGITS.search(x) else "0" for x in _WORD.findall(plain(body))]
    out: list[int] = []
    for x in w:
        out += _word_features(x)
    out += [crc32(f"b{a} {b}".encode()) & _MASK for a, b in zip(["^", *w], [*w, "$"])]
    out += [crc32(f"s{a} {b}".encode()) & _MASK for a, b in zip(w, w[2:])]
    return np.unique(np.array(out, dtype=np.int32))


def _flat(docs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all sentences in a row, their sentence, and where sentences and documents begin."""
    lengths = np.array([len(s) for d in docs for s in d])
    per = np.array([len(d) for d in docs])
    first = np.concatenate([[0], np.cumsum(lengths)])
    return np.concatenate([s for d in docs for s in d]), np.repeat(np.arange(len(lengths)), lengths), first, np.concatenate([[0], np.cumsum(per)])


def fit(docs: list[list[np.ndarray]], labels: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.08, decay: float = 3e-3, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (heads x features) and biases from documents' labels alone: a document's probability is the noisy-or of its
    sentences'. Adaptive gradient steps over batches of documents in a seeded order; soft labels where reviewers disagree."""
    seen = np.zeros(1 << BITS, dtype=np.int64)
    for d, y in zip(docs, labels.max(axis=1)):
        if y >= 0.5 and d:
            seen[np.unique(np.concatenate(d))] += 1
    has = seen >= SUPPORT
    sizes = [[len(x) for x in d] for d in docs]
    docs = [[x[has[x]] for x in d] for d in docs]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    docs, labels = [docs[i] for i in order], labels[order]
    idx, sent, first, start = _flat(docs)
    scale = 3.0 / np.sqrt(np.maximum(1, np.concatenate([sizes[i] for i in order])))
    n, heads = len(docs), labels.shape[1]
    w, b = np.zeros((heads, 1 << BITS)), np.full(heads, -4.0)
    gw, gb = np.full((heads, 1 << BITS), 1e-3), np.full(heads, 1.0)
    # Batches stay the same, only their order changes: what does not depend on the weights is laid out once.
    batches = []
    for lo in range(0, n, batch):
        hi = min(n, lo + batch)
        s0, s1 = start[lo], start[hi]
        f0, f1 = first[s0], first[s1]
        u, inv = np.unique(idx[f0:f1], return_inverse=True)
        of = sent[f0:f1] - s0
        batches.append((labels[lo:hi], u, inv.astype(np.int32), of.astype(np.int32), scale[s0:s1], scale[s0:s1][of], np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))))
    for _ in range(epochs):
        for c in rng.permutation(len(batches)):
            y_all, u, inv, of, sc, each, doc = batches[c]
            for h in range(heads):
                wu = w[h, u]
                z = np.bincount(of, wu[inv], len(sc)) * sc + b[h]
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y_all)))
                y = y_all[:, h]
                # Gradient of the log loss by each sentence's logit.
                g = (1 - y)[doc] * p - (y * none / np.maximum(1 - none, 1e-9))[doc] * p
                d = np.bincount(inv, g[of] * each, len(u)) + decay * wu
                gw[h, u] += d * d
                w[h, u] = wu - rate * d / np.sqrt(gw[h, u])
                gb[h] += g.sum() ** 2
                b[h] -= rate * g.sum() / np.sqrt(gb[h])
    # In memory a feature's weights of all heads lie together.
    return np.ascontiguousarray(w.T.astype(np.float32)).T, b


def noisy_or(p: np.ndarray) -> np.ndarray:
    """Probability that one of the sentences (rows) at least is a case, each above its leak."""
    return 1 - np.prod(1 - np.maximum(0.0, p - LEAK) / (1 - LEAK), axis=0)


def document_scores(docs: list[list[np.ndarray]], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Noisy-or of the sentences of each document (rows) under each head."""
    return np.array([noisy_or(sentence_scores(d, w, b)) for d in docs])


Docs = tuple[list[list[np.ndarray]], np.ndarray]
#: What a fit runs on: (documents it learns from, head or None for all, documents it scores); and what it gives.
Job = tuple[np.ndarray, int, np.ndarray]
Fitted = tuple[np.ndarray, float, np.ndarray]


def run_job(data: Docs, job: Job) -> Fitted:
    """Weights and bias of one head fitted to some documents, and the scores of others."""
    docs, y = data
    learn, head, score = job
    w, b = fit([docs[i] for i in learn], y[learn][:, head : head + 1])
    return w[0], float(b[0]), document_scores([docs[i] for i in score], w, b)[:, 0] if len(score) else np.empty(0)


def train(y: np.ndarray, run: Callable[[list[Job]], list[Fitted]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and threshold from labels (documents x heads) and a way to run fits. The last head is any of the others.
    Two folds score each other; labels that contradict a sure score are taken for wrong and left out (how sure it must be
    depends on the share of labelled cases the folds find); the threshold maximises F1 of the scores out of fold over the
    labels kept."""
    n, heads, hit = len(y), y.shape[1], y[:, -1] >= 0.5
    every, keep, threshold = np.arange(n), np.ones(n, dtype=bool), 0.5
    if n >= 20 and 0 < hit.sum() < n:
        side = every % 2 == 1
        for _ in range(2):  # the second time without what the first found wrong
            out = np.empty(n)
            folds = [(every[~s & keep], heads - 1, every[s]) for s in (side, ~side)]
            for (_, _, scored), (_, _, p) in zip(folds, run(folds)):
                out[scored] = p
            sure = next((x for share, x in SURE if (out[hit & keep] >= 0.5).mean() >= share), 0.0)
            keep = ~((hit & (out < sure)) | (~hit & (out > 1 - sure)))

        def f1(t: float) -> float:
            got = out[keep] >= t
            return 2 * (got & hit[keep]).sum() / max(1, got.sum() + hit[keep].sum())

        threshold = max(THRESHOLDS, key=lambda t: (f1(t), -abs(t - 0.5)))
    done = run([(every[keep], h, every[:0]) for h in range(heads)])
    return np.stack([w for w, _, _ in done]), np.array([b for _, b, _ in done]), threshold


def sentence_scores(fs: list[np.ndarray], w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability of each sentence (rows) under each head."""
    rows = w.T  # the fit hands weights over feature by feature
    sizes = np.array([len(f) for f in fs])
    out = np.zeros((len(fs), len(b)))
    some = np.flatnonzero(sizes)
    # By blocks of sentences: one gather and one sum for all of a block.
    for i in range(0, len(some), 4096):
        at = some[i : i + 4096]
        n = sizes[at]
        out[at] = np.add.reduceat(rows[np.concatenate([fs[k] for k in at])], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) * (3.0 * n**-0.5)[:, None]
    return 1 / (1 + np.exp(-np.clip(out + b, -30, 30)))


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> tuple[list[tuple[bytes, bytes]], np.ndarray]:
    """Features and labels (mean over reviewers, and any) of at most so many labelled documents and bytes, those of the least
    hash of their id. The features stay bytes: only the fits unpack them."""
    want = [F.coalesce(F.avg(h), F.lit(0.0)).alias(h) for h in HEADS]
    l = labels.filter("doc_id is not null").groupBy("doc_id").agg(*want).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # A bounded side, so it is broadcast: the documents are not shuffled for it.
    rows = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(l), "doc_id").dropDuplicates(["doc_id"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fs = [[f for f in (features(s) for s in sentences(t)) if len(f)] for t in x["text"]]
            sizes = [np.array([len(f) for f in d], dtype=np.int32).tobytes() for d in fs]
            yield pd.DataFrame({"doc_id": x["doc_id"], "f": [np.concatenate(d).tobytes() if d else b"" for d in fs], "sizes": sizes, **{h: x[h] for h in HEADS}})

    got = rows.mapInPandas(build, "doc_id long, f binary, sizes binary, " + ", ".join(f"{h} double" for h in HEADS))
    # At most `most` rows in this window; what goes on to the driver has at most `most_bytes`.
    by = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    got = got.filter("octet_length(sizes) > 0").withColumn("upto", F.sum(F.octet_length("f")).over(by)).filter(F.col("upto") <= most_bytes).toPandas().sort_values("doc_id")
    y = got[list(HEADS)].to_numpy(dtype=float)
    return list(zip(got["f"], got["sizes"])), np.column_stack([y, y.max(axis=1)]) if len(y) else np.empty((0, len(HEADS) + 1))


def unpacked(packed: list[tuple[bytes, bytes]]) -> list[list[np.ndarray]]:
    return [np.split(np.frombuffer(f, dtype=np.int32), np.cumsum(np.frombuffer(n, dtype=np.int32))[:-1]) for f, n in packed]


def fitted(spark: SparkSession, packed: list[tuple[bytes, bytes]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, its fits run as tasks on the broadcast features, one fit a task."""
    data = spark.sparkContext.broadcast((packed, y))

    def run(jobs: list[Job]) -> list[Fitted]:
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for no in x["id"]:
                    w, b, p = run_job((unpacked(data.value[0]), data.value[1]), jobs[no])
                    yield pd.DataFrame({"id": [no], "w": [w.astype(np.float32).tobytes()], "b": [b], "p": [p.tobytes()]})

        got = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(work, "id long, w binary, b double, p binary").toPandas().sort_values("id")
        return [(np.frombuffer(w, dtype=np.float32), b, np.frombuffer(p)) for w, b, p in zip(got["w"], got["b"], got["p"])]

    return train(y, run)


def scores(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, source, abusive, hateful, sexual, score, is_case, worst (number of the worst sentence), sentence of every document.

    Sentences' probabilities come from a linear model of disguise-free words, pairs and letter groups, fitted to document
    labels by noisy-or; a document's scores are the noisy-or of its sentences, and it is a case from the threshold on that
    was best out of fold. Whole texts are scored. Null, empty and blank texts have score 0 and no worst sentence; without any
    label every score is 0. Repeated rows stay. The fits, run as tasks, take at most MOST_LABELLED documents with at most MOST_BYTES
    of features; the weights (heads x 2^BITS floats) are broadcast.
    """
    packed, y = labelled(documents, labels, most)
    model = fitted(documents.sparkSession, packed, y) if len(packed) and y.max() > 0 else (np.zeros((len(HEADS) + 1, 1 << BITS), dtype=np.float32), np.full(len(HEADS) + 1, -30.0), 0.5)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, threshold = shared.value
        w = np.ascontiguousarray(w.T).T
        known: dict[str, np.ndarray] = {}
        bodies: dict[str, str] = {}

        def learn(sentences: set[str]) -> None:
            """Scores of all sentences of a batch that are not known yet, at once. Numbers are all one word, so sentences that
            differ in them alone are one."""
            for s in sentences:
                if s not in bodies:
                    bodies[s] = _NUMBERS.sub("0", _SPEAKER.sub("", s, count=1))
            new = list({bodies[s] for s in sentences} - known.keys())
            if new:
                known.update(zip(new, sentence_scores([features(x) for x in new], w, b)))

        for x in batches:
            if len(bodies) > 50_000:
                bodies.clear()
                known.clear()
            texts = [sentences(text) if text else [] for text in x["text"]]
            learn({s for ss in texts for s in ss})
            out = []
            for doc, source, ss in zip(x["doc_id"], x["source"], texts):
                if not ss:
                    out.append((doc, source, 0.0, 0.0, 0.0, 0.0, False, None, None))
                    continue
                p = np.array([known[bodies[s]] for s in ss])
                heads = noisy_or(p)
                worst = int(np.argmax(p[:, -1]))
                out.append((doc, source, *map(float, heads), bool(heads[-1] >= threshold), worst, ss[worst]))
            o = pd.DataFrame(out, columns=["doc_id", "source", *HEADS, "score", "is_case", "worst", "sentence"])
            o["worst"] = o["worst"].astype("Int32")
            yield o

    rows = spread(documents.select("doc_id", "source", "text"))
    return rows.mapInPandas(run, "doc_id long, source string, abusive double, hateful double, sexual double, score double, is_case boolean, worst int, sentence string")


def cases(scored: DataFrame) -> DataFrame:
    """doc_id of the cases, each once."""
    return scored.filter("is_case and doc_id is not null").select("doc_id").distinct()


def rates(scored: DataFrame) -> DataFrame:
    """source, documents, cases, rate, mean_score, and mean scores of the three heads; a null source is one source."""
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("is_case").cast("long")).alias("cases"), F.avg(F.col("is_case").cast("double")).alias("rate"), F.avg("score").alias("mean_score"), *[F.avg(h).alias(f"mean_{h}") for h in HEADS])
