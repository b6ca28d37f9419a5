"""Mixing of sources to target shares of tokens (problem 7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tokenizer import token_ids
from factloom.sources.tables import checkpoint

#: Parts of a source's permutation: with b of them only about 1/b of the source is sorted, in many tasks.
CELLS = 4096
#: A document is long with more than this part of its source's tokens, so a source has fewer than LONG of them.
LONG = 200


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares to a power, normalised: 1 leaves them, 0 makes them equal."""
    p = {k: x**exponent if x > 0 else 0.0 for k, x in shares.items()}
    t = sum(p.values())
    return {k: x / t for k, x in p.items()} if t else {}


def bisect(f, lo: float, hi: float, steps: int = 80) -> float:
    """Where f, false at lo and true at hi, turns true."""
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) else (mid, hi)
    return hi


def entropy_weights(tokens: dict[str, int], target: float) -> tuple[dict[str, float], float]:
    """Temperature mixing without targets: weights and the exponent at which the tempered shares of tokens have the target
    entropy. Targets outside what exponents from 0 to 16 reach give the nearer end."""
    total = sum(tokens.values())
    shares = {k: n / total for k, n in tokens.items() if n > 0}
    if not shares:
        return {}, 1.0
    a = bisect(lambda x: entropy(tempered(shares, x)) <= target, 0.0, 16.0)
    return tempered(shares, a), a


def limited(tokens: dict[str, int], weight: dict[str, float], repeats: dict[str, int]) -> int:
    """The most tokens that the weights can have without a source repeated beyond its limit."""
    return int(min((repeats[k] * tokens[k] / w for k, w in weight.items() if w > 0), default=0))


def target_weights(tokens: dict[str, int], targets: dict[str, float], repeats: dict[str, int], budget: int | None = None) -> tuple[dict[str, float], float, int]:
    """Weights, exponent and budget in tokens that keep all repetition limits.

    Without a budget the weights are the targets over the sources that have tokens and may be used, and the budget is the
    largest that no limit forbids. With a budget, weights go from the targets (exponent 1 of the ratio of target to token
    share) towards the token shares (exponent 0) just as far as the limits need; a budget beyond all limits is lowered.
    """
    t = {k: n for k, n in tokens.items() if n > 0 and targets.get(k, 0) > 0 and repeats.get(k, 0) >= 1}
    if not t:
        return {}, 1.0, 0
    total, goal = sum(t.values()), sum(targets[k] for k in t)
    share = {k: n / total for k, n in t.items()}
    ratio = {k: targets[k] / goal / share[k] for k in t}

    def at(a: float) -> dict[str, float]:
        w = {k: share[k] * ratio[k] ** a for k in t}
        s = sum(w.values())
        return {k: x / s for k, x in w.items()}

    fits = lambda w: limited(t, w, repeats)
    if budget is None:
        return at(1.0), 1.0, fits(at(1.0))
    if fits(at(1.0)) >= budget:
        return at(1.0), 1.0, budget
    if fits(at(0.0)) < budget:
        return at(0.0), 0.0, fits(at(0.0))
    a = 1.0 - bisect(lambda x: fits(at(1.0 - x)) >= budget, 0.0, 1.0)
    return at(a), a, budget


def counted(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, n_tokens of every document with a source, written once: totals, cells and choice all read it."""
    return checkpoint(token_ids(documents.filter("source is not null and doc_id is not null"), path, counts_only=True, keep=("doc_id", "source")))


def long_part(long: list[tuple[int, int, int]], tokens: int, rest: int) -> set[int]:
    """Ids of a source's long documents (order, id, tokens) in a block cut to `rest` of its `tokens`: walked in order, they fill
    their part of it, or what the others leave, and one that does not fit is passed over."""
    total = sum(n for _, _, n in long)
    room = max(rest * total // tokens, rest - (tokens - total))
    out = set()
    for _, doc, n in sorted(long):
        if n <= room:
            out.add(doc)
            room -= n
    return out


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, target_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Chosen documents (doc_id, source, n_tokens, repeats) and a report per source.

    The weights are the targets as far as the limits and the budget allow (target_weights); or, with a target entropy, the
    tempered token shares of the sources with a target (entropy_weights), the budget then lowered to what the limits allow.

    A source's budget is filled with blocks, each a whole permutation of its documents by a hash of seed, block and id; the
    last block is cut before the document that would exceed the budget. So a document comes floor(budget / tokens) times or
    once more, never more than max_repeats. The cut needs running sums: those of the cells of the permutation are few, and
    only documents of the cell that holds the cut are sorted, so a source with a third of all rows is no single task. Long
    documents, fewer than LONG a source, are placed one by one in the block that is cut, so that none ends it early.

    Null or empty texts have no tokens; they are chosen with the whole blocks only. Documents of sources without target, of
    targets without documents and rows without doc_id or source are left out, the other targets keep their proportions.
    Repeated rows of an id are one document of its largest size. The report has one row per source on either side,
    with null target_share and max_repeats where it has no target:
    source, target_share, weight, max_repeats, source_tokens, budget_tokens, actual_tokens, actual_share, copies, repeats, exponent.
    """
    spark = sizes.sparkSession
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).filter("source is not null")
    t = t.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = sizes.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    # Only sources with a target reach the driver; their number is that of the targets table (fixed, at most thousands).
    goal = {r["source"]: r for r in t.limit(100_001).collect()}
    if len(goal) > 100_000:
        raise ValueError("mix_targets has more than 100 000 sources")
    known = docs.filter("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    tokens = {r["source"]: r["source_tokens"] for r in known.join(F.broadcast(t.select("source")), "source", "left_semi").collect()}
    share, most = {k: r["target_share"] or 0.0 for k, r in goal.items()}, {k: r["max_repeats"] or 0 for k, r in goal.items()}
    if target_entropy is None:
        weight, exponent, total = target_weights(tokens, share, most, budget)
    else:
        weight, exponent = entropy_weights({k: n for k, n in tokens.items() if share[k] > 0 and most[k] >= 1}, target_entropy)
        total = min(limited(tokens, weight, most), budget if budget is not None else sum(tokens.values()) * max(most.values(), default=0))
    # Long documents and the cells of the others; a source has fewer than LONG long ones.
    of = F.broadcast(spark.createDataFrame(list(tokens.items()), "source string, total long"))
    docs = docs.join(of, "source").withColumn("long", F.col("n_tokens") * LONG > F.col("total")).drop("total")
    order = F.xxhash64(F.lit(seed + 1), F.col("doc_id"))
    long: dict[str, list[tuple[int, int, int]]] = {}
    for r in docs.filter("long").select("source", order.alias("at"), "doc_id", "n_tokens").collect():
        long.setdefault(r["source"], []).append((r["at"], r["doc_id"], r["n_tokens"]))
    plan, placed_long = [], []
    for k, w in weight.items():
        want = min(int(total * w), tokens[k] * most[k])
        whole, rest = divmod(want, tokens[k])
        more = long_part(long.get(k, []), tokens[k], rest)
        taken = sum(n for _, doc, n in long.get(k, []) if doc in more)
        plan.append((k, want, whole, rest - taken))
        placed_long += [(doc, k, n, whole + (doc in more)) for _, doc, n in long.get(k, [])]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, budget_tokens long, whole long, rest long"))
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(CELLS)).cast("int")
    docs = docs.filter("not long").withColumn("cell", cell)
    cells = docs.groupBy("source", "cell").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy("source").orderBy("cell")
    ends = cells.withColumn("until", F.sum("n").over(run)).join(plan_df, "source")
    state = ends.select("source", "cell", "whole", "rest", (F.col("until") - F.col("n")).alias("before"), F.when(F.col("until") <= F.col("rest"), "in").when(F.col("until") - F.col("n") >= F.col("rest"), "out").otherwise("cut").alias("state"))
    placed = docs.join(F.broadcast(state) if len(goal) <= 64 else state, ["source", "cell"])
    within = Window.partitionBy("source", "cell").orderBy(order, "doc_id")
    cut = placed.filter("state = 'cut'").withColumn("upto", F.col("before") + F.sum("n_tokens").over(within)).withColumn("more", (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    rest = placed.filter("state <> 'cut'").withColumn("more", (F.col("state") == "in").cast("int"))
    out = rest.unionByName(cut).withColumn("repeats", (F.col("whole") + F.when(F.col("n_tokens") > 0, F.col("more")).otherwise(0)).cast("int"))
    out = out.select("doc_id", "source", "n_tokens", "repeats").unionByName(spark.createDataFrame(placed_long, "doc_id long, source string, n_tokens long, repeats int"))
    chosen = out.filter("repeats > 0")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.sum("repeats").alias("copies"), F.max("repeats").alias("repeats"))
    w_df = spark.createDataFrame([(k, float(x)) for k, x in weight.items()], "source string, weight double")
    report = t.join(known, "source", "full").join(w_df, "source", "left").join(plan_df.select("source", "budget_tokens"), "source", "left").join(got, "source", "left")
    report = report.withColumn("all_tokens", F.sum("actual_tokens").over(Window.partitionBy(F.lit(0))))
    zero = lambda c, z=0: F.coalesce(c, F.lit(z))
    return chosen, report.select(
        "source", "target_share", "max_repeats", zero("weight", 0.0).alias("weight"), zero("source_tokens").alias("source_tokens"), zero("budget_tokens").alias("budget_tokens"),
        zero("actual_tokens").alias("actual_tokens"), zero(F.col("actual_tokens") / F.col("all_tokens"), 0.0).alias("actual_share"), zero("copies").alias("copies"), zero("repeats").alias("repeats"), F.lit(float(exponent)).alias("exponent"),
    )
