"""Entity graph: canonical ids, closures, bounded context, degrees, merge candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.tables import checkpoint


def canonical(merges: DataFrame, hops: int = 64) -> DataFrame:
    """from_id, into_id of every merged entity followed to its end, by pointer doubling: log2(hops) joins.

    A cycle, or a chain of more than hops merges, raises ValueError. Null ids are left out; of several active merges of one
    entity the least target counts.
    """
    step = merges.filter("from_id is not null and into_id is not null").groupBy("from_id").agg(F.min("into_id").alias("into_id"))
    step = checkpoint(step)
    reach = 1
    while True:
        b = step.select(F.col("from_id").alias("into_id"), F.col("into_id").alias("_next"))
        nxt = checkpoint(step.join(b, "into_id", "left").select("from_id", F.coalesce("_next", "into_id").alias("into_id"), F.col("_next").isNotNull().alias("moved")))
        if nxt.filter("from_id = into_id").limit(1).count():
            raise ValueError("cycle among merges")
        if not nxt.filter("moved").limit(1).count():
            return nxt.select("from_id", "into_id")
        reach *= 2
        if reach > hops:
            raise ValueError(f"merge chain of more than {hops} hops")
        step = nxt.select("from_id", "into_id")


def closure(merges: DataFrame) -> DataFrame:
    """entity_id, member_id: every end of merges with all that is merged into it, itself included."""
    c = canonical(merges)
    own = c.select(F.col("into_id").alias("entity_id"), F.col("into_id").alias("member_id")).distinct()
    return c.select(F.col("into_id").alias("entity_id"), F.col("from_id").alias("member_id")).unionByName(own)


def context(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int = 256) -> DataFrame:
    """start, node, depth, truncated: nodes within depth steps in either direction, at most `most` per start.

    Breadth first, one join per level (depth at most 4); nodes beyond the bound are cut by (depth, node), and the mark says so.
    The bound is the feature: a context for a reader.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth from 1 to 4")
    from pyspark.sql import Window

    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))).filter("node is not null and to is not null").distinct()
    front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    seen = front
    for k in range(1, depth + 1):
        step = front.select("start", "node").join(both, "node").select("start", F.col("to").alias("node")).distinct()
        front = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k))
        front = front.withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy("node"))).filter(F.col("_r") <= most + 1).drop("_r")
        seen = checkpoint(seen.unionByName(front))
        front = seen.filter(F.col("depth") == k)
    r = seen.withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy("depth", "node"))).filter(F.col("_r") <= most + 1)
    r = r.withColumn("truncated", F.max(F.col("_r") > most).over(Window.partitionBy("start")))
    return r.filter(F.col("_r") <= most).select("start", "node", "depth", "truncated")


def degrees(edges: DataFrame) -> DataFrame:
    """node, links: edges a node takes part in, as source or target; a loop counts twice."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).filter("node is not null").groupBy("node").agg(F.count("*").alias("links"))


def block_candidates(names: DataFrame, id: str, name: str, judged: DataFrame | None = None) -> DataFrame:
    """id, partner, n_block: names that share their first word (three letters or more), each with the least other id of its
    block as representative, without pairs that were judged. A block of any size gives one row per member, not all pairs."""
    word = F.regexp_extract(F.lower(F.col(name)), r"^[^\p{L}\p{N}]*([\p{L}\p{N}]{3,})", 1)
    rows = names.select(F.col(id).alias("id"), word.alias("block")).filter("id is not null and block <> ''").dropDuplicates(["id"])
    b = rows.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n_block")).filter("n_block > 1")
    out = rows.join(b, "block").filter("id <> first").select(F.col("id"), F.col("first").alias("partner"), "n_block")
    if judged is not None:
        out = out.join(judged.select("id", "partner"), ["id", "partner"], "left_anti")
    return out
