"""Encoding of texts with a public byte-level BPE vocabulary (problem 6)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import spread

#: Distinct pieces whose ids a worker remembers, and the longest piece it remembers.
CACHE, CACHED_LENGTH = 200_000, 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, which is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(n) for t, n in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: a queue of merges by (rank, place) over a doubly linked list of symbols; entries whose symbols
    have changed since are stale and skipped. O(n log n) however long the piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    sym: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, size = heapq.heappop(queue)
        left = sym[i]
        if left is None or (j := nxt[i]) >= n or len(left) + len(sym[j]) != size:
            continue
        sym[i], sym[j] = left + sym[j], None
        nxt[i] = k = nxt[j]
        if k < n:
            prv[k] = i
            pair = sym[i] + sym[k]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(queue, (r, i, len(pair)))
        if (p := prv[i]) >= 0:
            pair = sym[p] + sym[i]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(queue, (r, p, len(pair)))
    return [ranks[s] for s in sym if s is not None]


class Encoder:
    """Text to ids and back."""

    def __init__(self, path: str, pattern: str | None = None):
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        self.ranks, self.find = load_ranks(path), regex.compile(pattern).findall
        self.tokens = None
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts give no ids. Lone surrogates, which UTF-8 cannot hold, become U+FFFD."""
        out: list[int] = []
        known, ranks = self.known, self.ranks
        for p in self.find(text or ""):
            ids = known.get(p)
            if ids is None:
                ids = merge(p.encode("utf-8", "replace") if p.isascii() else p.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode(), ranks)
                if len(p) <= CACHED_LENGTH:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the vocabulary's strings one after the other."""
        if self.tokens is None:
            self.tokens = {i: t for t, i in self.ranks.items()}
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(documents: DataFrame, path: str | None = None, counts_only: bool = False, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with ids (list of integers) of each document, or n_tokens with counts_only.

    One row per input row. A null or an empty text has the empty list (0 tokens); blanks are encoded as they are. Repeated
    rows stay. Other columns are ignored. path is a vocabulary file of ranks, readable by every worker.
    """
    path = path or vocabulary_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            ids = [e.encode(t) for t in b[text]]
            out = b[list(keep)].copy()
            out["n_tokens" if counts_only else "ids"] = [len(i) for i in ids] if counts_only else ids
            yield out

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    rows = spread(documents.select(*keep, text))
    return rows.mapInPandas(encode, f"{schema}, {'n_tokens long' if counts_only else 'ids array<int>'}")


def vocabulary_use(encoded: DataFrame) -> DataFrame:
    """token_id, n of each token of the corpus, counted before the shuffle."""
    return encoded.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("n"))
