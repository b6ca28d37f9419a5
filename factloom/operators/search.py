"""Full-text search: stored inverted index, prefix terms, BM25, excerpts (S15, section 2.12)."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.filters import check_request
from factloom.sources.tables import partitions, shared_folder

_FROM = "äöüàáâãåèéêëìíîïòóôõùúûýÿñç"
_TO = "aouaaaaaeeeeiiiioooouuuyync"
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(text), _FROM, _TO), F.lit(r"[a-z0-9]+"), F.lit(0))


class Index(NamedTuple):
    """terms: id, term, tf, len (words of the document), bucket (the term's first sign); size: n documents, average len."""

    terms: DataFrame
    size: DataFrame


def postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """id, term, tf, len: the inverted index; counted ahead of the shuffle. Null and empty texts have none."""
    t = docs.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), tokens(F.col(text)).alias("ts"))
    return t.select("id", F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf")).select("id", "term", "tf", "len")


def write_index(docs: DataFrame, id: str, text: str, path: str) -> None:
    """The index of documents of distinct ids, as files: a folder for each first sign of a term and terms in order within the
    files, so that a prefix reads few row groups. Cut by range of term and id: a frequent term is many tasks' work."""
    p = postings(docs, id, text).withColumn("bucket", F.substring("term", 1, 1))
    p.repartitionByRange(partitions(docs.sparkSession), "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    size = docs.filter(F.col(text).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text)))).alias("avg"))
    size.write.mode("overwrite").parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str) -> Index:
    terms = spark.read.schema("id " + spark.read.parquet(f"{path}/terms").schema["id"].dataType.simpleString() + ", term string, tf long, len int, bucket string").parquet(f"{path}/terms")
    return Index(terms, spark.read.parquet(f"{path}/size"))


_WRITTEN: dict[tuple[str, str], str] = {}


def index_of(docs: DataFrame, id: str, text: str, name: str) -> Index:
    """The index of a table that does not change while the application runs, written once in the shared folder and then read."""
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, f"{name} {id} {text}")
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/index-{key[0]}-{hashlib.md5(key[1].encode()).hexdigest()[:12]}"
        write_index(docs, id, text, path)
        _WRITTEN[key] = path
    return read_index(spark, _WRITTEN[key])


def words(query: str) -> list[str]:
    """The words of a query, at most 16."""
    return "".join(c if c.isalnum() else " " for c in query.lower().translate(str.maketrans(_FROM, _TO))).split()[:16]


def search(index: Index, query: str, limit: int = 30) -> DataFrame:
    """id, score, rank, more: documents in which every word of the query begins a word, by BM25 over the matching terms, ties by
    id; more: whether there are others beyond the limit, which is the feature.

    At most 16 words. Only the folders of the words' first signs and the row groups of their prefixes are read. A query out of
    bounds raises ValueError; one without words finds nothing.
    """
    check_request(query, limit=limit)
    ws = words(query)
    of = F.col("term").startswith(ws[0]) if ws else F.lit(False)
    for w in ws[1:]:
        of = of | F.col("term").startswith(w)
    p = index.terms.filter(F.col("bucket").isin(sorted({w[0] for w in ws})) & of)
    hits = [F.sum(F.when(F.col("term").startswith(w), F.col("tf")).otherwise(0)).alias(f"t{i}") for i, w in enumerate(ws)]
    t = p.groupBy("id").agg(F.first("len").alias("len"), *(hits or [F.max(F.lit(0)).alias("t0")]))
    found = t.agg(F.count("*").alias("_"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(ws))])
    every, s = F.lit(True), F.lit(0.0)
    for i in range(len(ws)):
        every = every & (F.col(f"t{i}") > 0)
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        tf = F.col(f"t{i}").cast("double")
        s = s + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    # One row each: the size of the corpus and the counts of the query's words.
    r = t.filter(every).join(F.broadcast(found.join(F.broadcast(index.size)))).select("id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit + 1)
    r = r.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return r.withColumn("more", F.max("rank").over(Window.partitionBy(F.lit(0))) > limit).filter(F.col("rank") <= limit)


def excerpts(hits: DataFrame, docs: DataFrame, id: str, text: str, query: str, width: int = 500, ahead: int = 100) -> DataFrame:
    """id, rank, more, excerpt: up to `width` characters around the first place where a word of the query begins a word. Hits are
    few (the limit of the search), so they are broadcast."""
    plain = F.translate(F.lower(F.col(text)), _FROM, _TO)
    at = lambda w: F.regexp_instr(plain, F.lit(rf"(?<![a-z0-9]){w}"))
    places = F.array(*[at(w) for w in words(query)])
    first = F.array_min(F.filter(places, lambda x: x > 0))
    begin = F.greatest(F.coalesce(first, F.lit(1)) - ahead, F.lit(1))
    return docs.join(F.broadcast(hits.withColumnRenamed("id", id)), id).select(F.col(id).alias("id"), "rank", "more", F.substring(F.col(text), begin, F.lit(width)).alias("excerpt"))
