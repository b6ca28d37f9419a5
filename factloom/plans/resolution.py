"""Queries from typed values to entities, assertions and links, and on the logs around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import graph, resolution, timeline
from factloom.plans.facts import _CLOSED, closed
from factloom.plans.registry import query
from factloom.sources.tables import checkpoint, table

# Dimensions of the queries: identifiers that back a role, slots that make an assertion, relations to the issuer.
ROLES = [("meter_number", k, "contract", "meter") for k in ("energy_contract", "water_contract")] + [("contract_number", k, "contract", "contract") for k in ("policy", "loan")] + [("staff_number", "employment", "job", "staff")]
SLOTS = [
    ("rent", "tenancy", "costs.rent", "money", "open"), ("gross_pay", "employment", "income.gross", "money", "open"), ("living_area", "tenancy", "home.area", "quantity", "timeless"),
    ("start_date", "policy", "cover.start", "date", "timeless"), ("mileage", "vehicle", "vehicle.mileage", "quantity", "open"), ("tariff", "energy_contract", "supply.tariff", "text", "open"),
]
RELATIONS = [("policy", "insured_by"), ("loan", "owed_to"), ("employment", "employed_by"), ("tenancy", "rented_from"), ("bank_account", "held_at")]

_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
_E = "e AS (SELECT DISTINCT entity_id, vault, kind, deleted_at FROM entities WHERE entity_id IS NOT NULL)"


def values(spark: SparkSession, d: str) -> DataFrame:
    """Values with the kind of their subject; rows of a repeated id once."""
    v = table(spark, d, "slot_values").dropDuplicates(["value_id"])
    e = table(spark, d, "entities").select(F.col("entity_id").alias("subject_id"), "kind").dropDuplicates(["subject_id"])
    return v.join(e, "subject_id")


_V = "k AS (SELECT DISTINCT entity_id AS subject_id, kind FROM entities), v AS (SELECT DISTINCT s.*, k.kind FROM slot_values s JOIN k USING (subject_id))"


@query(f"""WITH {_V}, r(slot, kind, role, namespace) AS (VALUES {_values(ROLES)}),
  a AS (SELECT value_id, vault, subject_id, kind, role, namespace || ':' || upper(regexp_replace(value_text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) || '@' || coalesce(vault, '') AS key FROM v JOIN r USING (slot, kind) WHERE regexp_replace(value_text, '[^\\p{{L}}\\p{{N}}]', '', 'g') <> ''),
  f AS (SELECT kind, key, arg_min(subject_id, value_id) AS entity_id FROM a GROUP BY ALL)
  SELECT value_id, vault, role, key, entity_id, false AS created FROM a JOIN f USING (kind, key)""")
def x16_roles(spark: SparkSession, d: str) -> DataFrame:
    v = values(spark, d).select("value_id", "vault", "subject_id", "kind", "slot", scalars.normalize_identifier(F.col("value_text")).alias("value"))
    return resolution.resolved_roles(v, spark.createDataFrame(ROLES, "slot string, kind string, role string, namespace string"))


@query(f"""WITH {_V}, r(slot, kind, property, property_type, time_rule) AS (VALUES {_values(SLOTS)}),
  a AS (SELECT value_id, subject_id, property, value_type, time_rule, CAST(recorded_at AS DATE) AS day, CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence, coalesce(check_flag, false) AS blocked
        FROM v JOIN r USING (slot, kind) WHERE value_type = property_type AND trim(coalesce(value_text, amount)) <> '')
  SELECT value_id, subject_id, property, value_type, CASE WHEN time_rule = 'timeless' THEN 'timeless' WHEN day IS NOT NULL THEN 'interval' ELSE 'unknown' END AS time_kind,
         CAST(CASE WHEN time_rule = 'open' THEN day END AS VARCHAR) AS valid_from, confidence, blocked FROM a""")
def x17_assertions(spark: SparkSession, d: str) -> DataFrame:
    v = values(spark, d).select("value_id", "subject_id", "kind", "slot", "value_type", F.coalesce("value_text", "amount").alias("value"), F.to_date("recorded_at").alias("day"), "confidence", "check_flag")
    a = resolution.typed_assertions(v, spark.createDataFrame(SLOTS, "slot string, kind string, property string, property_type string, time_rule string"))
    return a.withColumn("valid_from", F.col("valid_from").cast("string"))


@query(f"""WITH {_V}, r(kind, relation) AS (VALUES {_values(RELATIONS)})
  SELECT subject_id, issuer_id AS object_id, relation, min(confidence) AS confidence, count(*) AS n FROM v JOIN r USING (kind) WHERE issuer_id IS NOT NULL GROUP BY ALL""")
def x18_links(spark: SparkSession, d: str) -> DataFrame:
    return resolution.links(values(spark, d).withColumnRenamed("issuer_id", "object_id"), spark.createDataFrame(RELATIONS, "kind string, relation string"))


def merge_log(spark: SparkSession, d: str) -> DataFrame:
    """A log of merges: entities of a vault into its first of the same kind, every fifth reversed later, every seventh into the
    vault's first of any kind (refused where the kinds differ)."""
    e = table(spark, d, "entities").select("entity_id", "vault", "kind").dropDuplicates(["entity_id"])
    n = F.substring("entity_id", 5, 20).cast("long")
    same, any_ = e.groupBy("vault", "kind").agg(F.min("entity_id").alias("first")), e.groupBy("vault").agg(F.min("entity_id").alias("head"))
    m = e.join(same, ["vault", "kind"]).join(any_, "vault").withColumn("n", n)
    into = F.when(F.col("n") % 7 == 0, F.col("head")).otherwise(F.col("first"))
    merges = m.select((F.col("n") * 2).alias("seq"), F.lit("merge").alias("action"), F.col("entity_id").alias("from_id"), into.alias("into_id"))
    return merges.unionByName(m.filter("n % 5 = 0").select((F.col("n") * 2 + 1).alias("seq"), F.lit("reverse").alias("action"), F.col("entity_id").alias("from_id"), into.alias("into_id")))


_LOG = _E + """, q AS (SELECT *, min(entity_id) OVER (PARTITION BY vault, kind) AS first, min(entity_id) OVER (PARTITION BY vault) AS head, CAST(substr(entity_id, 5) AS BIGINT) AS n FROM e),
  l AS (SELECT n * 2 AS seq, 'merge' AS action, entity_id AS from_id, CASE WHEN n % 7 = 0 THEN head ELSE first END AS into_id FROM q UNION ALL
        SELECT n * 2 + 1, 'reverse', entity_id, CASE WHEN n % 7 = 0 THEN head ELSE first END FROM q WHERE n % 5 = 0),
  ok AS (SELECT l.* FROM l JOIN e a ON a.entity_id = from_id JOIN e b ON b.entity_id = into_id WHERE from_id <> into_id AND a.kind = b.kind AND a.deleted_at IS NULL AND b.deleted_at IS NULL),
  m AS (SELECT from_id, arg_max(into_id, seq) AS into_id FROM ok GROUP BY 1 HAVING arg_max(action, seq) = 'merge')"""


@query(f"WITH {_LOG} SELECT from_id, into_id FROM m")
def x25_merges(spark: SparkSession, d: str) -> DataFrame:
    return resolution.active_merges(merge_log(spark, d), table(spark, d, "entities"))


@query(f"""WITH RECURSIVE {_LOG}, r AS (SELECT from_id, into_id FROM m UNION ALL SELECT r.from_id, m.into_id FROM r JOIN m ON r.into_id = m.from_id), c AS (SELECT from_id, into_id FROM r WHERE into_id NOT IN (SELECT from_id FROM m)),
  i AS (SELECT DISTINCT slot AS namespace, upper(regexp_replace(value_text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS value, subject_id FROM slot_values WHERE value_type = 'identifier' AND value_text IS NOT NULL AND subject_id IS NOT NULL)
  SELECT DISTINCT namespace, value, coalesce(into_id, subject_id) AS entity_id FROM i LEFT JOIN c ON from_id = subject_id""")
def x42_holders(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "slot_values").filter("value_type = 'identifier'").select(F.col("slot").alias("namespace"), scalars.normalize_identifier(F.col("value_text")).alias("value"), F.col("subject_id").alias("entity_id"))
    return resolution.holders(i, graph.canonical(x25_merges(spark, d)))


@query("""WITH s AS (SELECT DISTINCT fact_id, source_id, property, value FROM extracted_facts), o AS (SELECT * FROM s WHERE fact_id % 3 <> 0), n AS (SELECT * FROM s WHERE fact_id % 3 = 0)
  SELECT * FROM o WHERE source_id IS NULL OR source_id NOT IN (SELECT source_id FROM n WHERE source_id IS NOT NULL) UNION ALL SELECT * FROM n""")
def x29_replaced(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_facts").select("fact_id", "source_id", "property", "value").distinct()
    return resolution.replaced(f.filter("fact_id % 3 <> 0"), f.filter("fact_id % 3 = 0"))


@query(f"""WITH {_CLOSED}, bad AS (SELECT value_id FROM c x WHERE value IS NOT NULL AND EXISTS (SELECT 1 FROM c y WHERE y.subject_id = x.subject_id AND y.slot = x.slot AND y.value <> x.value AND (y.valid_to IS NULL OR x.valid_from < y.valid_to) AND (x.valid_to IS NULL OR y.valid_from < x.valid_to))),
  e AS (SELECT DISTINCT entity_id, kind FROM entities WHERE deleted_at IS NULL), w AS (SELECT DISTINCT value_id, subject_id, slot, source_id, coalesce(check_flag, false) AS flag FROM slot_values WHERE subject_id IS NOT NULL),
  s AS (SELECT subject_id, slot AS neighbour, 'slot' AS relation, CASE WHEN bool_or(value_id IN (SELECT value_id FROM bad)) THEN 'conflict' WHEN bool_or(flag) THEN 'check' ELSE 'settled' END AS status, count(*) AS n FROM w GROUP BY 1, 2
        UNION ALL SELECT subject_id, source_id, 'evidence', 'settled', count(*) FROM w WHERE source_id IS NOT NULL GROUP BY 1, 2)
  SELECT subject_id AS node, kind, neighbour, relation, status, n FROM s JOIN e ON entity_id = subject_id""")
def x30_projection(spark: SparkSession, d: str) -> DataFrame:
    c = checkpoint(closed(spark, d).select("value_id", "subject_id", "slot", "valid_from", "valid_to", "value"))
    v = table(spark, d, "slot_values").dropDuplicates(["value_id"])
    return resolution.projection(table(spark, d, "entities"), v, timeline.conflicts(c, ["subject_id", "slot"], "value_id"))


_FOLDERS = {"banking": "finance", "tax": "finance", "insurance": "insurance", "housing": "home", "energy": "home", "work": "work", "health": "health"}
_FAMILY = "c AS (SELECT source_id, arg_max(family, classified_at) AS family FROM (SELECT DISTINCT source_id, family, classified_at FROM classifications WHERE classified_at IS NOT NULL) GROUP BY 1)"


def families(spark: SparkSession, d: str) -> DataFrame:
    """The family of the latest classification of each source."""
    c = table(spark, d, "classifications").filter("classified_at is not null")
    return c.groupBy("source_id").agg(F.max_by("family", "classified_at").alias("family"))


@query(f"""WITH {_FAMILY} SELECT source_id, family, CASE family {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _FOLDERS.items())} ELSE 'unsorted' END AS folder FROM c""")
def x34_folders(spark: SparkSession, d: str) -> DataFrame:
    folder = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _FOLDERS.items() for x in kv]), F.col("family")), F.lit("unsorted"))
    return families(spark, d).select("source_id", "family", folder.alias("folder"))


@query("""SELECT source_id, property, quote, min(fact_id) AS fact_id, count(*) - 1 AS repeats FROM extracted_facts GROUP BY ALL""")
def x48_observations(spark: SparkSession, d: str) -> DataFrame:
    return resolution.observations(table(spark, d, "extracted_facts"), "source_id", ["property", "quote"], "fact_id")


@query("""WITH o AS (SELECT min(fact_id) AS fact_id FROM extracted_facts GROUP BY source_id, property, quote), w AS (SELECT event_id AS seq, user_id * 7 AS fact_id, 'a' || (event_id % 50) AS assertion_id FROM events)
  SELECT fact_id, arg_min(assertion_id, seq) AS assertion_id FROM w WHERE fact_id IN (SELECT fact_id FROM o) GROUP BY 1""")
def x48_mapped(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") * 7).alias("fact_id"), F.concat(F.lit("a"), F.col("event_id") % 50).alias("assertion_id"))
    return resolution.mapped(x48_observations(spark, d), w, "fact_id")


@query(f"""WITH {_FAMILY}, s AS (SELECT DISTINCT vault, source_id, received_at FROM sources WHERE vault IS NOT NULL), t AS (SELECT DISTINCT source_id FROM parts WHERE trim(coalesce(text, '')) <> ''), f AS (SELECT DISTINCT source_id FROM classifications WHERE doc_type IS NOT NULL),
  r AS (SELECT s.vault, s.source_id, c.family, row_number() OVER (PARTITION BY s.vault ORDER BY received_at DESC NULLS LAST, s.source_id) AS rank FROM s JOIN t USING (source_id) JOIN c USING (source_id) WHERE s.source_id NOT IN (SELECT source_id FROM f))
  SELECT * FROM r WHERE rank <= 20""")
def x49_unfiled(spark: SparkSession, d: str) -> DataFrame:
    filed = table(spark, d, "classifications").filter("doc_type is not null").select("source_id").distinct()
    return resolution.unfiled(table(spark, d, "sources"), table(spark, d, "parts"), filed, families(spark, d))


@query("""WITH p AS (SELECT DISTINCT segment_id, source_id, text, method FROM parts), f AS (SELECT *, substr(md5(coalesce('=' || method, '-') || chr(31) || coalesce('=' || text, '-')), 1, 16) AS fingerprint FROM p)
  SELECT source_id, segment_id, fingerprint, segment_id <> min(segment_id) OVER (PARTITION BY fingerprint) AS reused FROM f""")
def w7_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parts").select("segment_id", "source_id", "text", "method").distinct()
    return resolution.steps(p, ["method", "text"], "segment_id", "source_id")


@query("""WITH l AS (SELECT DISTINCT login_id, username, website, category, version, versions FROM logins), r AS (
    SELECT login_id, 0 AS o, 0 AS i, 'username' AS part, 'username' AS label, username AS value FROM l UNION ALL SELECT login_id, 1, 0, 'password', 'password', 'set' FROM l
    UNION ALL SELECT login_id, 2, 0, 'field', 'category', category FROM l UNION ALL SELECT login_id, 3, 0, 'section', 'Web / website', website FROM l UNION ALL SELECT login_id, 3, 1, 'section', 'Web / versions', CAST(versions AS VARCHAR) FROM l
    UNION ALL SELECT login_id, 4, -k, 'history', 'v' || k, 'set' FROM l, unnest(range(versions)) AS u(k))
  SELECT login_id, row_number() OVER (PARTITION BY login_id ORDER BY o, i) - 1 AS ordinal, part, label, value FROM r""")
def w14_login_fields(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "logins").select("login_id", "username", "website", "category", "version", "versions").distinct()
    field = lambda what, label, value: F.struct(F.lit(what).alias("designation"), F.lit(label).alias("label"), value.alias("value"))
    fields = F.array(field(None, "category", F.col("category")), field("password", "Password", F.lit("secret")), field("username", "User", F.col("username")))
    web = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("string").alias("value")) for x in ("website", "versions")])
    history = F.transform(F.sequence(F.lit(0), F.col("versions") - 1), lambda k: F.struct(F.lit("old").alias("value"), F.concat(F.lit("v"), k).alias("at")))
    history = F.when(F.col("versions") > 0, history)
    doc = F.to_json(F.struct(fields.alias("fields"), F.array(F.struct(F.lit("Web").alias("title"), web.alias("fields"))).alias("sections"), history.alias("history")))
    return resolution.login_fields(l.select("login_id", doc.alias("details")), "login_id", "details")


_TEXT = "CASE p_size % 4 WHEN 0 THEN 'Klasse ' || CASE p_size % 6 WHEN 0 THEN 'I' WHEN 1 THEN 'II' WHEN 2 THEN 'III' WHEN 3 THEN 'IV' WHEN 4 THEN 'V' ELSE 'VI' END WHEN 1 THEN 'Stufe 0' || (p_size % 9) || ' von 9' WHEN 2 THEN ' Frei ' ELSE p_name END"


@query(f"""WITH t AS (SELECT p_partkey, {_TEXT} AS text FROM part), x AS (SELECT *, regexp_extract(text, '(?:^|[^\\p{{L}}\\p{{N}}])([0-9]+|[IVX]+)(?:$|[^\\p{{L}}\\p{{N}}])', 1) AS token FROM t),
  n AS (SELECT *, CASE token WHEN 'I' THEN '1' WHEN 'II' THEN '2' WHEN 'III' THEN '3' WHEN 'IV' THEN '4' WHEN 'V' THEN '5' WHEN 'VI' THEN '6' WHEN '' THEN NULL ELSE CASE WHEN ltrim(token, '0') = '' THEN '0' ELSE ltrim(token, '0') END END AS number FROM x)
  SELECT p_partkey, CASE WHEN lower(trim(text)) = 'frei' THEN 'frei' WHEN number IN ('1', '2', '3', '4', '5', '6') THEN number END AS key FROM n""")
def v16_category_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", resolution.category_key(F.expr(_TEXT), ["1", "2", "3", "4", "5", "6", "frei"]).alias("key"))


@query("SELECT segment_id, substr(md5(coalesce('=' || source_id, '-') || chr(31) || coalesce('=' || text, '-')), 1, 16) AS version FROM (SELECT DISTINCT segment_id, source_id, text FROM parts)")
def v21_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").select("segment_id", "source_id", "text").distinct().select("segment_id", resolution.fingerprint(F.col("source_id"), F.col("text")).alias("version"))


@query("""WITH s AS (SELECT 'employer-' || (i % 12) AS subject_id, CAST(3000 + i AS VARCHAR) AS value, make_date(2000 + i // 12, i % 12 + 1, 1) AS valid_from FROM range(1000) AS t(i))
  SELECT subject_id, value, CAST(valid_from AS VARCHAR) AS valid_from, CAST(lead(valid_from) OVER (PARTITION BY subject_id ORDER BY valid_from) AS VARCHAR) AS valid_to FROM s""")
def t2_thousand_documents(spark: SparkSession, d: str) -> DataFrame:
    """The scale test of the survey: a thousand payslips of twelve employers, brought to closed timelines."""
    i = F.col("id")
    s = spark.range(1000).select(F.concat(F.lit("employer-"), i % 12).alias("subject_id"), (i + 3000).cast("string").alias("value"), F.make_date((i / 12).cast("int") + 2000, (i % 12 + 1).cast("int"), F.lit(1)).alias("valid_from"))
    return timeline.retimeline(s, ["subject_id"]).select("subject_id", "value", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))
