"""Queries on graphs, intake, budgets, change capture and logins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import accounting, graph
from factloom.plans.registry import query
from factloom.sources.tables import table


def merges(spark: SparkSession, d: str) -> DataFrame:
    """Customers merged into half their number, those of even numbers: chains that end at odd numbers."""
    return table(spark, d, "customer").filter("c_custkey % 2 = 0 and c_custkey > 0").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") / 2).cast("long").alias("into_id"))


_MERGES = "m AS (SELECT c_custkey AS from_id, c_custkey // 2 AS into_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey > 0)"
_ENDS = f"WITH RECURSIVE {_MERGES}, r AS (SELECT from_id, into_id FROM m UNION ALL SELECT r.from_id, m.into_id FROM r JOIN m ON r.into_id = m.from_id), e AS (SELECT from_id, into_id FROM r WHERE into_id NOT IN (SELECT from_id FROM m))"


@query(f"{_ENDS} SELECT from_id, into_id FROM e")
def x3_canonical(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical(merges(spark, d))


@query(f"{_ENDS} SELECT into_id AS entity_id, from_id AS member_id FROM e UNION SELECT into_id, into_id FROM e")
def x4_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(merges(spark, d))


def edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return n.unionByName(s)


_EDGES = "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), b AS (SELECT src AS a, dst AS z FROM e UNION SELECT dst, src FROM e)"


@query(f"""WITH {_EDGES}, l1 AS (SELECT DISTINCT 'r' || r_regionkey AS start, z AS node FROM region JOIN b ON a = 'r' || r_regionkey), l2 AS (SELECT DISTINCT start, z AS node FROM l1 JOIN b ON a = node),
  u AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT start, node, 1 FROM l1 UNION ALL SELECT start, node, 2 FROM l2)
  SELECT start, node, min(depth) AS depth, false AS truncated FROM u GROUP BY start, node""")
def x6_context(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return graph.context(edges(spark, d), starts, 2, 100_000)


@query("SELECT node, count(*) AS links FROM (SELECT 'c' || o_custkey AS node FROM orders UNION ALL SELECT 'o' || o_orderkey FROM orders) GROUP BY 1")
def x21_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst")))


@query(f"WITH {_EDGES}, d AS (SELECT node, count(*) AS links FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT node, links, row_number() OVER (ORDER BY links DESC, node) AS rank FROM d ORDER BY links DESC, node LIMIT 20")
def l7_ranking(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    top = graph.degrees(edges(spark, d)).orderBy(F.desc("links"), "node").limit(20)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("links"), "node")).cast("long"))


@query(r"WITH x AS (SELECT p_partkey AS id, regexp_extract(lower(p_name), '^[^\p{L}\p{N}]*([\p{L}\p{N}]{3,})', 1) AS block FROM part), b AS (SELECT block, min(id) AS partner, count(*) AS n_block FROM x WHERE block <> '' GROUP BY 1 HAVING count(*) > 1) SELECT id, partner, n_block FROM x JOIN b USING (block) WHERE id <> partner")
def x24_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return graph.block_candidates(table(spark, d, "part"), "p_partkey", "p_name")


@query("WITH f AS (SELECT doc_id AS id, sha256(text) AS fingerprint FROM documents), m AS (SELECT fingerprint, min(id) AS first FROM f WHERE fingerprint IS NOT NULL GROUP BY 1) SELECT id, f.fingerprint, CAST(CASE WHEN first <> id THEN first END AS VARCHAR) AS duplicate_of FROM f LEFT JOIN m USING (fingerprint)")
def s10_intake(spark: SparkSession, d: str) -> DataFrame:
    return accounting.intake(table(spark, d, "documents"), "doc_id", F.col("text")).withColumn("duplicate_of", F.col("duplicate_of").cast("string"))


@query("SELECT vault, fingerprint, min(source_id) AS source_id FROM sources WHERE vault IS NOT NULL AND fingerprint IS NOT NULL GROUP BY ALL")
def s11_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return accounting.deliveries(table(spark, d, "sources").select("vault", "fingerprint", "source_id"), "vault", "fingerprint", "source_id").filter("vault is not null and fingerprint is not null").select("vault", "fingerprint", "source_id")


@query("WITH p AS (SELECT event_id AS seq, props AS payload FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100), s AS (SELECT *, row_number() OVER w AS n, sum(octet_length(encode(payload))) OVER w AS b FROM p WINDOW w AS (ORDER BY seq)) SELECT seq, payload FROM s WHERE n = 1 OR b <= 800")
def s19_export(spark: SparkSession, d: str) -> DataFrame:
    return accounting.export(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("props").alias("payload")), 500, size=800)


@query()
def w1_reservation(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("tokens"))
    return accounting.reserve(r, "user_id", "event_id", "tokens", 12, 1500)


@query("SELECT event_type, count(*) AS calls, coalesce(sum(t), 0)::BIGINT AS tokens, count(*) FILTER (t IS NULL) AS unreported, greatest(12, count(*)) AS call_limit, greatest(180000, coalesce(sum(t), 0))::BIGINT AS token_limit FROM (SELECT event_type, CASE WHEN event_id % 7 > 0 THEN floor(value)::BIGINT END AS t FROM events) GROUP BY 1")
def w2_usage(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 7 > 0, F.floor("value").cast("long")).alias("t"))
    return accounting.usage(r, "event_type", "t")


@query("WITH r AS (SELECT user_id, event_type, max(floor(value))::BIGINT AS tokens FROM events GROUP BY ALL) SELECT * FROM r")
def w3_monotone_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(F.floor("value")).cast("long").alias("tokens"))


@query("SELECT vault, count(*) AS files, count(*) FILTER (retention = 'keep') AS kept FROM (SELECT DISTINCT source_id, vault, retention FROM sources) GROUP BY 1 HAVING count(*) FILTER (retention = 'keep') = count(*)")
def w4_exhausted(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source_id", "vault", "retention").distinct()
    return s.groupBy("vault").agg(F.count("*").alias("files"), F.count_if(F.coalesce(F.col("retention") == "keep", F.lit(False))).alias("kept")).filter("kept = files")


@query("WITH done AS (SELECT DISTINCT fingerprint FROM sources WHERE kind = 'pdf') SELECT DISTINCT s.source_id, s.fingerprint FROM sources s WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.fingerprint IS NOT DISTINCT FROM s.fingerprint)")
def w6_stage_memo(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source_id", "fingerprint", "kind")
    return accounting.pending(s.select("source_id", "fingerprint"), s.filter("kind = 'pdf'"), ["fingerprint"]).distinct()


@query("""WITH a AS (SELECT c_custkey AS id, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 > 0), b AS (SELECT c_custkey AS id, c_name, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 > 0)
  SELECT id, CASE WHEN a.c_name IS NULL THEN 'insert' WHEN b.c_name IS NULL THEN 'delete' ELSE 'update' END AS operation FROM a FULL JOIN b USING (id) WHERE a.c_name IS DISTINCT FROM b.c_name OR a.c_mktsegment IS DISTINCT FROM b.c_mktsegment""")
def w9_journal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    after = c.filter("id % 11 > 0").withColumn("c_mktsegment", F.when(F.col("id") % 7 == 0, "CHANGED").otherwise(F.col("c_mktsegment")))
    return accounting.journal(c.filter("id % 10 > 0"), after, "id", ["c_name", "c_mktsegment"]).select("id", "operation")


@query("SELECT event_id, user_id, CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) AS parent FROM events")
def w9_causal(spark: SparkSession, d: str) -> DataFrame:
    return accounting.causal(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], "event_id").withColumn("parent", F.col("parent").cast("string"))


@query("WITH l AS (SELECT DISTINCT login_id, vault, website, username FROM logins) SELECT login_id, count(*) OVER (PARTITION BY vault, website) AS n_versions, row_number() OVER (PARTITION BY vault, website ORDER BY login_id) AS n_version FROM l")
def w13_login_versions(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "logins").select("login_id", "vault", "website", "username").distinct()
    return accounting.versions(l, ["vault", "website"], "login_id").select("login_id", "n_versions", F.col("n_version").cast("long").alias("n_version"))


@query("SELECT login_id FROM (SELECT DISTINCT login_id, favorite, deleted_at, archived FROM logins) WHERE deleted_at IS NULL AND NOT archived ORDER BY favorite DESC, login_id LIMIT 20")
def l6_claims(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "logins").filter("deleted_at is null and not archived").select("login_id", "favorite").distinct()
    return accounting.claims(l, [F.desc("favorite"), F.col("login_id")], 20).select("login_id")


@query("SELECT event_id, k AS props_k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def j12_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("props_k")).filter("props_k is not null")
