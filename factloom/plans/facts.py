"""Queries on the evidence-backed facts of the document store: filters, joins, aggregates, timelines, review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import filters, grounding, timeline
from factloom.plans.registry import query
from factloom.sources.tables import checkpoint, table

DAY = "2023-06-30"


def assertions(spark: SparkSession, d: str) -> DataFrame:
    """slot_values as assertions: one value per subject and slot from the day it was recorded on; users' rows are decided."""
    v = table(spark, d, "slot_values").select("value_id", "source_id", "subject_id", "slot", "value_text", "amount", "period", "confidence", "source", "check_flag", "value_checked", "recorded_at", "currency", "value_type", "vault")
    v = v.dropDuplicates(["value_id"])
    user = F.coalesce(F.lower(F.trim("source")) == "user", F.lit(False))
    return v.select("value_id", "source_id", "subject_id", "slot", "vault", "value_type", "currency", F.coalesce("value_text", "amount").alias("value"), "period", "confidence", user.alias("user_decided"), "check_flag", "value_checked", F.to_date("recorded_at").alias("valid_from"))


_A = """a AS (SELECT DISTINCT value_id, source_id, subject_id, slot, vault, value_type, currency, coalesce(value_text, amount) AS value, period, confidence,
  coalesce(lower(trim(source)) = 'user', false) AS user_decided, check_flag, value_checked, CAST(recorded_at AS DATE) AS valid_from FROM slot_values)"""
_CLOSED = _A + """, c AS (SELECT *, (SELECT min(b.valid_from) FROM (SELECT DISTINCT subject_id, slot, value, valid_from FROM a WHERE NOT user_decided AND value IS NOT NULL) b
  WHERE b.subject_id = a.subject_id AND b.slot = a.slot AND b.valid_from > a.valid_from AND b.value <> a.value) AS valid_to FROM a WHERE NOT user_decided)"""


def closed(spark: SparkSession, d: str) -> DataFrame:
    return timeline.retimeline(assertions(spark, d).filter("not user_decided"), ["subject_id", "slot"])


@query(f"WITH {_CLOSED} SELECT value_id, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to FROM c")
def x7_retimeline(spark: SparkSession, d: str) -> DataFrame:
    return closed(spark, d).select("value_id", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query(f"""WITH {_CLOSED} SELECT value_id FROM c x WHERE value IS NOT NULL AND EXISTS (SELECT 1 FROM c y WHERE y.subject_id = x.subject_id AND y.slot = x.slot AND y.period IS NOT DISTINCT FROM x.period
  AND y.value <> x.value AND (y.valid_to IS NULL OR x.valid_from < y.valid_to) AND (x.valid_to IS NULL OR y.valid_from < x.valid_to))""")
def x8_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return timeline.conflicts(checkpoint(closed(spark, d).select("value_id", "subject_id", "slot", "period", "valid_from", "valid_to", "value")), ["subject_id", "slot", "period"], "value_id")


@query(f"""WITH {_CLOSED}, e AS (SELECT subject_id, slot, CASE WHEN value IS NOT NULL AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR DATE '{DAY}' < valid_to) THEN value END AS v FROM c),
  g AS (SELECT subject_id, slot, count(DISTINCT v) AS n_values, min(v) AS lo FROM e GROUP BY ALL)
  SELECT subject_id, slot, CASE WHEN n_values = 0 THEN 'missing' WHEN n_values > 1 THEN 'conflict' ELSE 'resolved' END AS status, n_values, CASE WHEN n_values = 1 THEN lo END AS value FROM g""")
def x2_resolve(spark: SparkSession, d: str) -> DataFrame:
    rows = closed(spark, d).withColumn("kind", F.lit("interval"))
    return timeline.resolve(rows, ["subject_id", "slot"], F.lit(DAY).cast("date"))


@query(f"""WITH o AS (SELECT o_custkey AS subject_id, o_orderstatus AS value, CAST(o_orderdate AS DATE) AS valid_from FROM orders), s AS (SELECT DISTINCT * FROM o),
  c AS (SELECT s.*, (SELECT min(b.valid_from) FROM s b WHERE b.subject_id = s.subject_id AND b.valid_from > s.valid_from AND b.value <> s.value) AS valid_to FROM s),
  e AS (SELECT subject_id, CASE WHEN valid_from <= DATE '1998-01-01' AND (valid_to IS NULL OR DATE '1998-01-01' < valid_to) THEN value END AS v FROM c),
  g AS (SELECT subject_id, count(DISTINCT v) AS n_values, min(v) AS lo FROM e GROUP BY ALL)
  SELECT subject_id, CASE WHEN n_values = 0 THEN 'missing' WHEN n_values > 1 THEN 'conflict' ELSE 'resolved' END AS status, n_values, CASE WHEN n_values = 1 THEN lo END AS value FROM g""")
def t1_timeline_asof(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("value"), F.to_date("o_orderdate").alias("valid_from")).distinct()
    rows = timeline.retimeline(o, ["subject_id"]).withColumn("kind", F.lit("interval"))
    return timeline.resolve(rows, ["subject_id"], F.lit("1998-01-01").cast("date"))


_EV = "SELECT user_id AS assertion_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'accept' ELSE 'retract' END AS action, CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'policy' END AS actor FROM events"


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The event log as decisions on users, in order of event_id."""
    t = F.col("event_type")
    action = F.when(t == "purchase", "accept").when(t == "error", "reject").when(t == "view", "accept").otherwise("retract")
    return table(spark, d, "events").select(F.col("user_id").alias("assertion_id"), F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_id") % 3 == 0, "user").otherwise("policy").alias("actor"))


@query(f"WITH e AS ({_EV}), l AS (SELECT assertion_id, max_by(action, seq) AS state, max_by(actor, seq) AS actor FROM e GROUP BY 1) SELECT c_custkey AS assertion_id, coalesce(state, 'proposed') AS state, actor FROM customer LEFT JOIN l ON c_custkey = assertion_id")
def x1_state(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("assertion_id"))
    return timeline.latest_state(a, decisions(spark, d))


@query(f"WITH e AS ({_EV}), l AS (SELECT assertion_id, max_by(actor, seq) AS actor, max_by(action, seq) AS action FROM e GROUP BY 1) SELECT assertion_id, CASE WHEN actor = 'user' THEN 'reviewed' WHEN actor = 'policy' AND action = 'retract' THEN 'check' ELSE 'unreviewed' END AS review FROM l")
def x14_review_state(spark: SparkSession, d: str) -> DataFrame:
    l = decisions(spark, d).groupBy("assertion_id").agg(F.max_by("actor", "seq").alias("actor"), F.max_by("action", "seq").alias("action"))
    return l.select("assertion_id", timeline.review_state(F.col("actor"), F.when(F.col("action") == "retract", "retracted")).alias("review"))


@query("""WITH o AS (SELECT event_id, ts, value FROM events), r AS (SELECT * FROM o WHERE value / 100 >= 0.8 ORDER BY ts DESC, event_id DESC LIMIT 50), g AS (SELECT count(*) AS n, coalesce(sum(CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END), 0)::BIGINT AS corrected FROM r)
  SELECT n, corrected, CASE WHEN n < 20 THEN 0.8 WHEN corrected * 10 > n THEN 0.9 WHEN corrected = 0 THEN 0.7 ELSE 0.8 END::DOUBLE AS threshold FROM g""")
def x15_threshold(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events").select(F.col("event_id").alias("outcome_id"), F.col("ts").alias("recorded_at"), (F.col("value") / 100).alias("confidence"), (F.col("event_id") % 9 == 0).alias("corrected"))
    return timeline.threshold(o)


@query(f"""WITH {_A}, k AS (SELECT DISTINCT source_id FROM sources WHERE kind = 'email'), cor AS (SELECT subject_id, slot, period, min(source_id) AS lo, max(source_id) AS hi FROM a WHERE source_id IN (SELECT source_id FROM k) GROUP BY ALL)
  SELECT value_id FROM a WHERE NOT user_decided AND EXISTS (SELECT 1 FROM cor WHERE cor.subject_id IS NOT DISTINCT FROM a.subject_id AND cor.slot IS NOT DISTINCT FROM a.slot AND cor.period IS NOT DISTINCT FROM a.period AND (a.source_id IS NULL OR lo <> a.source_id OR hi <> a.source_id))""")
def x10_superseded(spark: SparkSession, d: str) -> DataFrame:
    rows = assertions(spark, d)
    mail = table(spark, d, "sources").filter("kind = 'email'").select("source_id").distinct()
    return timeline.superseded(rows, rows.join(mail, "source_id", "left_semi"), ["subject_id", "slot", "period"], "value_id")


@query("""WITH e AS (SELECT DISTINCT subject_id || '|' || slot AS assertion_id, source_id FROM slot_values WHERE source_id IS NOT NULL AND subject_id IS NOT NULL), s AS (SELECT DISTINCT subject_id || '|' || slot AS assertion_id, source_id FROM slot_values WHERE value_checked AND source_id IS NOT NULL),
  n AS (SELECT assertion_id, count(DISTINCT source_id) AS n FROM e GROUP BY 1)
  SELECT e.assertion_id, e.source_id, CASE WHEN n > 1 THEN 'unlink' ELSE 'retract' END AS action FROM e JOIN n USING (assertion_id) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.assertion_id = e.assertion_id AND s.source_id = e.source_id)""")
def x11_withdrawn(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").filter("source_id is not null and subject_id is not null").select(F.concat_ws("|", "subject_id", "slot").alias("assertion_id"), "source_id", "value_checked")
    return timeline.withdrawn(v, v.filter("value_checked"))


@query(f"""WITH {_A}, g AS (SELECT subject_id, slot, value, period, max_by(confidence, coalesce(confidence, -1)) AS confidence, bool_or(coalesce(check_flag, false)) AS conflict FROM a WHERE value IS NOT NULL GROUP BY ALL) SELECT subject_id, slot, value, period, confidence, conflict FROM g""")
def x13_review_upsert(spark: SparkSession, d: str) -> DataFrame:
    a = assertions(spark, d).filter("value is not null")
    return a.groupBy("subject_id", "slot", "value", "period").agg(F.max_by("confidence", F.coalesce("confidence", F.lit(-1.0))).alias("confidence"), F.max(F.coalesce("check_flag", F.lit(False))).alias("conflict"))


@query(f"""WITH {_A} SELECT value_id, CASE WHEN user_decided THEN 'user' WHEN value_checked THEN 'keep' WHEN check_flag THEN 'blocked' ELSE 'accept' END AS decision FROM a""")
def x12_auto_accept(spark: SparkSession, d: str) -> DataFrame:
    return assertions(spark, d).select("value_id", F.when(F.col("user_decided"), "user").when(F.col("value_checked"), "keep").when(F.col("check_flag"), "blocked").otherwise("accept").alias("decision"))


@query("""WITH s AS (SELECT DISTINCT source_id, kind, received_at FROM sources WHERE source_id IS NOT NULL), v AS (SELECT DISTINCT value_id, slot, source_id, try_strptime(value_text, '%Y-%m-%d')::DATE AS day FROM slot_values WHERE value_type = 'date')
  SELECT value_id, CASE WHEN day IS NOT NULL OR received_at IS NOT NULL THEN 'interval' ELSE 'unknown' END AS kind, CAST(coalesce(day, CAST(received_at AS DATE)) AS VARCHAR) AS valid_from, CAST(CASE WHEN slot = 'registered_on' AND day IS NOT NULL THEN day + 1 END AS VARCHAR) AS valid_to FROM v LEFT JOIN s USING (source_id)""")
def x19_validity(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source_id", F.to_date("received_at").alias("doc")).filter("source_id is not null").dropDuplicates(["source_id"])
    v = table(spark, d, "slot_values").filter("value_type = 'date'").select("value_id", "slot", "source_id", F.when(F.col("value_text").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("value_text", "yyyy-MM-dd")).alias("day")).dropDuplicates(["value_id"])
    j = v.join(s, "source_id", "left")
    kind = F.when((F.col("slot") == "registered_on") & F.col("day").isNotNull(), "period").otherwise("open")
    r = timeline.validity(kind, F.col("day"), F.col("day"), F.col("doc"))
    return j.select("value_id", r.alias("r")).select("value_id", "r.kind", F.col("r.valid_from").cast("string").alias("valid_from"), F.col("r.valid_to").cast("string").alias("valid_to"))


@query("SELECT DISTINCT source_id FROM sources WHERE sensitivity = 'personal' AND retention = 'keep'")
def f1_visible(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").filter(filters.visible(F.col("sensitivity"), F.col("retention"))).select("source_id").distinct()


@query(f"WITH {_CLOSED} SELECT value_id FROM c WHERE valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR DATE '{DAY}' < valid_to)")
def f3_as_of(spark: SparkSession, d: str) -> DataFrame:
    return closed(spark, d).filter(filters.effective(F.lit("interval"), F.col("valid_from"), F.col("valid_to"), F.lit(DAY).cast("date"))).select("value_id")


@query("SELECT DISTINCT fact_id, property FROM extracted_facts WHERE source_id IN (SELECT source_id FROM sources WHERE kind = 'note')")
def f4_scope(spark: SparkSession, d: str) -> DataFrame:
    return filters.scoped(table(spark, d, "extracted_facts").select("fact_id", "property", "source_id"), table(spark, d, "sources").filter("kind = 'note'"), "source_id").select("fact_id", "property").distinct()


@query("SELECT DISTINCT source_id FROM sources s WHERE NOT EXISTS (SELECT 1 FROM classifications c WHERE c.source_id = s.source_id)")
def f5_unread(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("source_id").distinct().join(table(spark, d, "classifications").select("source_id"), "source_id", "left_anti")


@query("SELECT entity_id, label FROM (SELECT DISTINCT entity_id, label FROM entities) WHERE entity_id NOT IN (SELECT subject_id FROM slot_values WHERE subject_id IS NOT NULL)")
def f6_without_values(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").select(F.col("subject_id").alias("entity_id"))
    return table(spark, d, "entities").select("entity_id", "label").distinct().join(v, "entity_id", "left_anti")


@query("""WITH s AS (SELECT DISTINCT source_id, retention, sensitivity FROM sources), f AS (SELECT source_id, count(DISTINCT fact_id) AS n FROM extracted_facts GROUP BY 1), c AS (SELECT source_id, min(readable) AS readable FROM classifications GROUP BY 1)
  SELECT s.source_id, CASE WHEN retention = 'purged' THEN 'purged' WHEN c.source_id IS NULL THEN 'unread' WHEN readable < 0.35 THEN 'needs_review' WHEN n IS NULL THEN 'manual' ELSE 'done' END AS status FROM s LEFT JOIN f USING (source_id) LEFT JOIN c USING (source_id)""")
def f8_status(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source_id", "retention", "sensitivity").distinct()
    f = table(spark, d, "extracted_facts").groupBy("source_id").agg(F.count_distinct("fact_id").alias("n"))
    c = table(spark, d, "classifications").groupBy("source_id").agg(F.min("readable").alias("readable"), F.lit(True).alias("read"))
    status = F.when(F.col("retention") == "purged", "purged").when(F.col("read").isNull(), "unread").when(F.col("readable") < 0.35, "needs_review").when(F.col("n").isNull(), "manual").otherwise("done")
    return s.join(f, "source_id", "left").join(c, "source_id", "left").select("source_id", status.alias("status"))


@query("SELECT DISTINCT source_id, title FROM sources s WHERE contains(lower(title), 'rechnung') OR EXISTS (SELECT 1 FROM parts p WHERE p.source_id = s.source_id AND contains(lower(p.text), 'kündigung'))")
def f9_substring(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "parts").filter(F.contains(F.lower("text"), F.lit("kündigung"))).select("source_id", F.lit(True).alias("hit")).distinct()
    s = table(spark, d, "sources").select("source_id", "title").distinct().join(hit, "source_id", "left")
    return s.filter(F.contains(F.lower("title"), F.lit("rechnung")) | F.col("hit")).select("source_id", "title")


_COMPACT = "regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"SELECT DISTINCT fact_id FROM data_facts WHERE (contains({_COMPACT.format('label')}, 'contract') OR contains({_COMPACT.format('value')}, 'contract')) AND (contains({_COMPACT.format('label')}, '9') OR contains({_COMPACT.format('value')}, '9'))")
def f10_local_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_facts").filter(filters.matches_words("my contract 9", F.col("label"), F.col("value"))).select("fact_id").distinct()


@query("SELECT DISTINCT value_id FROM slot_values WHERE value_checked OR (value_type IN ('money', 'date') AND coalesce(amount, value_text) IS NOT NULL)")
def f11_worth_reading(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slot_values").filter(F.col("value_checked") | (F.col("value_type").isin("money", "date") & F.coalesce("amount", "value_text").isNotNull())).select("value_id").distinct()


@query("SELECT DISTINCT value_id, CASE WHEN amount IS NOT NULL THEN concat_ws(' ', amount, currency, CASE WHEN period IS NOT NULL THEN 'per ' || period END) END AS shown FROM slot_values WHERE value_type = 'money'")
def f13_display(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slot_values").filter("value_type = 'money'").select("value_id", filters.display_money(F.col("amount"), F.col("currency"), F.col("period")).alias("shown")).distinct()


@query("SELECT property, max_by(label, fact_id) AS label FROM data_facts WHERE property IS NOT NULL GROUP BY 1")
def f14_catalog(spark: SparkSession, d: str) -> DataFrame:
    return filters.catalog(table(spark, d, "data_facts"))


@query("SELECT DISTINCT segment_id, coalesce('Page ' || CAST(CAST(page AS INT) AS VARCHAR), section, 'Source') || CASE WHEN lower(coalesce(method, '')) = 'ocr' THEN ' (OCR)' ELSE '' END AS place FROM parts")
def f15_location(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").select("segment_id", filters.location(F.col("page"), F.col("section"), F.col("method")).alias("place")).distinct()


@query("""SELECT e.kind, s.kind AS source_kind, count(DISTINCT v.value_id) AS n FROM slot_values v JOIN entities e ON v.subject_id = e.entity_id JOIN sources s ON v.source_id = s.source_id JOIN issuers i ON v.issuer_id = i.issuer_id WHERE e.deleted_at IS NULL AND s.sensitivity = 'personal' AND s.retention = 'keep' GROUP BY ALL""")
def j1_inner(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").select("value_id", "subject_id", "source_id", "issuer_id").dropDuplicates(["value_id"])
    e = table(spark, d, "entities").filter("deleted_at is null").select(F.col("entity_id").alias("subject_id"), "kind").distinct()
    s = table(spark, d, "sources").filter(filters.visible(F.col("sensitivity"), F.col("retention"))).select("source_id", F.col("kind").alias("source_kind")).distinct()
    i = table(spark, d, "issuers").select("issuer_id").distinct()
    return v.join(F.broadcast(i), "issuer_id", "left_semi").join(e, "subject_id").join(s, "source_id").groupBy("kind", "source_kind").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT source_id, max_by(family, classified_at) AS family, max(classified_at) AS seen FROM classifications GROUP BY 1), s AS (SELECT DISTINCT source_id FROM sources)
  SELECT source_id, family, CAST(floor(epoch(seen))::BIGINT AS VARCHAR) AS seen FROM s LEFT JOIN c USING (source_id)""")
def j4_latest_row(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "classifications").groupBy("source_id").agg(F.max_by("family", "classified_at").alias("family"), F.max("classified_at").alias("seen"))
    s = table(spark, d, "sources").select("source_id").distinct()
    return s.join(c, "source_id", "left").select("source_id", "family", F.floor(F.unix_micros(F.col("seen").cast("timestamp")) / 1e6).cast("long").cast("string").alias("seen"))


@query(f"""WITH {_CLOSED}, r AS (SELECT DISTINCT subject_id, received_at FROM (SELECT subject_id, CAST(received_at AS DATE) AS received_at FROM slot_values JOIN sources USING (source_id) WHERE value_type = 'date'))
  SELECT r.subject_id, CAST(r.received_at AS VARCHAR) AS day, slot, count(DISTINCT value) AS n FROM r JOIN c ON c.subject_id = r.subject_id AND c.valid_from <= r.received_at AND (c.valid_to IS NULL OR r.received_at < c.valid_to) WHERE value IS NOT NULL GROUP BY ALL""")
def j6_as_of_join(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").filter("value_type = 'date'").select("subject_id", "source_id")
    r = v.join(table(spark, d, "sources").select("source_id", F.to_date("received_at").alias("day")), "source_id").select("subject_id", "day").distinct()
    c = closed(spark, d).filter("value is not null").select("subject_id", "slot", "value", "valid_from", "valid_to").distinct()
    on = (F.col("c.subject_id") == F.col("r.subject_id")) & (F.col("c.valid_from") <= F.col("r.day")) & (F.col("c.valid_to").isNull() | (F.col("r.day") < F.col("c.valid_to")))
    return r.alias("r").join(c.alias("c"), on).groupBy(F.col("r.subject_id"), F.col("r.day").cast("string").alias("day"), "slot").agg(F.count_distinct("value").alias("n"))


@query("SELECT subject_id, slot, count(DISTINCT value_text) AS n_values, count(DISTINCT value_text) > 1 AS conflict FROM slot_values WHERE value_text IS NOT NULL GROUP BY ALL")
def g7_distinct_conflict(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "slot_values").filter("value_text is not null").groupBy("subject_id", "slot").agg(F.count_distinct("value_text").alias("n_values"))
    return g.withColumn("conflict", F.col("n_values") > 1)


@query("SELECT coalesce(family, 'other') AS family, count(DISTINCT source_id) AS n FROM classifications GROUP BY 1 ORDER BY n DESC, family")
def g1_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "classifications").groupBy(F.coalesce("family", F.lit("other")).alias("family")).agg(F.count_distinct("source_id").alias("n")).orderBy(F.desc("n"), "family")


@query("SELECT vault, count(DISTINCT source_id) AS files, count(DISTINCT CASE WHEN retention = 'purged' THEN source_id END) AS purged, sum(CASE WHEN title IS NULL THEN 1 ELSE 0 END)::BIGINT AS untitled, count(DISTINCT fingerprint) AS contents FROM (SELECT DISTINCT source_id, vault, retention, title, fingerprint FROM sources) GROUP BY 1")
def g2_batch_progress(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source_id", "vault", "retention", "title", "fingerprint").distinct()
    return s.groupBy("vault").agg(F.count_distinct("source_id").alias("files"), F.count_distinct(F.when(F.col("retention") == "purged", F.col("source_id"))).alias("purged"), F.count_if(F.col("title").isNull()).alias("untitled"), F.count_distinct("fingerprint").alias("contents"))


@query("WITH x AS (SELECT DISTINCT vault, source_id, subject_name FROM classifications WHERE trim(subject_name) <> '') SELECT vault, subject_name, count(DISTINCT source_id) AS documents FROM x GROUP BY ALL HAVING count(DISTINCT source_id) >= 3")
def g9_household(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "classifications").filter("trim(subject_name) <> ''")
    return c.groupBy("vault", "subject_name").agg(F.count_distinct("source_id").alias("documents")).filter("documents >= 3")


@query("""WITH j AS (SELECT DISTINCT source_id, vault, classified_at, least(1 - mixed, family_confidence, type_confidence, subject_confidence) AS confidence, mixed AS failure FROM classifications)
  SELECT source_id, round(confidence, 6) AS confidence, CASE WHEN coalesce(failure, 1) > 0.7 OR coalesce(confidence, 0) < 0.6 THEN 'reject' WHEN coalesce(confidence, 0) < 0.8 THEN 'check' ELSE 'accept' END AS band FROM j""")
def e9_e10_verdicts(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "classifications").select("source_id", "vault", "classified_at", "family_confidence", "type_confidence", "subject_confidence", "mixed")
    c = grounding.combine(F.col("family_confidence"), F.col("type_confidence"), F.col("subject_confidence"), failure=F.col("mixed"))
    j = j.select("source_id", "vault", "classified_at", c.alias("confidence"), F.col("mixed").alias("failure")).distinct()
    return j.select("source_id", F.round("confidence", 6).alias("confidence"), grounding.band(F.col("failure"), F.col("confidence"), F.lit(0.8)).alias("band"))


@query("""WITH f AS (SELECT *, CASE WHEN coalesce(family_confidence >= 0.5, false) AND family IS NOT NULL THEN family ELSE 'other' END AS fam FROM classifications)
  SELECT DISTINCT source_id, fam AS family, CASE WHEN fam <> 'other' AND coalesce(type_confidence >= 0.8, false) AND coalesce(readable >= 0.35, false) AND coalesce(mixed < 0.7, false) THEN doc_type END AS doc_type, CASE WHEN coalesce(subject_confidence >= 0.6, false) AND trim(subject_name) <> '' THEN subject_name END AS subject FROM f""")
def e17_classify(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("family", "family_confidence", "doc_type", "type_confidence", "readable", "mixed", "subject_name", "subject_confidence")]
    return table(spark, d, "classifications").select("source_id", grounding.classify(*c).alias("k")).select("source_id", "k.*").distinct()


@query(r"""WITH s AS (SELECT DISTINCT segment_id, text FROM parts WHERE segment_id IS NOT NULL), f AS (SELECT DISTINCT fact_id, segment_id, value, quote, subject_quote FROM extracted_facts),
  n AS (SELECT fact_id, value, quote, subject_quote, text, trim(regexp_replace(lower(value), '\s+', ' ', 'g')) AS v, trim(regexp_replace(lower(quote), '\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(subject_quote), '\s+', ' ', 'g')) AS s, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM f LEFT JOIN s USING (segment_id))
  SELECT fact_id, CASE WHEN value IS NULL OR trim(value) = '' OR quote IS NULL THEN 'no_value' WHEN text IS NULL THEN 'no_segment' WHEN NOT contains(t, q) THEN 'quote_missing' WHEN NOT contains(q, v) THEN 'value_missing' WHEN subject_quote IS NOT NULL AND trim(subject_quote) <> '' AND NOT contains(t, s) THEN 'subject_missing' ELSE 'ok' END AS code FROM n""")
def e2_ground(spark: SparkSession, d: str) -> DataFrame:
    return grounding.ground(table(spark, d, "extracted_facts"), table(spark, d, "parts"))


@query(r"""WITH s AS (SELECT DISTINCT segment_id, text FROM parts WHERE segment_id IS NOT NULL), f AS (SELECT DISTINCT fact_id, segment_id, value, quote, subject_quote FROM extracted_facts),
  n AS (SELECT fact_id, value, quote, subject_quote, text, trim(regexp_replace(lower(value), '\s+', ' ', 'g')) AS v, trim(regexp_replace(lower(quote), '\s+', ' ', 'g')) AS q, trim(regexp_replace(lower(subject_quote), '\s+', ' ', 'g')) AS s, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM f LEFT JOIN s USING (segment_id)),
  c AS (SELECT CASE WHEN value IS NULL OR trim(value) = '' OR quote IS NULL THEN 'no_value' WHEN text IS NULL THEN 'no_segment' WHEN NOT contains(t, q) THEN 'quote_missing' WHEN NOT contains(q, v) THEN 'value_missing' WHEN subject_quote IS NOT NULL AND trim(subject_quote) <> '' AND NOT contains(t, s) THEN 'subject_missing' ELSE 'ok' END AS code FROM n)
  SELECT code, count(*) AS n FROM c GROUP BY 1""")
def g8_code_histogram(spark: SparkSession, d: str) -> DataFrame:
    return e2_ground(spark, d).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT fact_id, instr(quote, value) - 1 AS start, instr(quote, value) - 1 + length(value) AS stop FROM extracted_facts WHERE instr(quote, value) > 0 AND length(value) > 0")
def e4_locate(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_facts").select("fact_id", grounding.locate(F.col("value"), F.col("quote")).alias("s")).filter("s is not null").distinct()
    return f.select("fact_id", "s.start", F.col("s.end").alias("stop"))


@query("SELECT source_id, min(currency) AS currency FROM slot_values WHERE currency IS NOT NULL AND source_id IS NOT NULL GROUP BY 1 HAVING min(currency) = max(currency)")
def e5_document_currency(spark: SparkSession, d: str) -> DataFrame:
    return grounding.document_currency(table(spark, d, "slot_values").select("source_id", "currency"))


@query("""WITH v AS (SELECT DISTINCT value_id, subject_id, slot, confidence FROM slot_values WHERE value_type = 'money'), n AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY subject_id, slot) AS n FROM v WINDOW w AS (PARTITION BY subject_id, slot ORDER BY value_id)),
  t AS (SELECT *, row_number() OVER (PARTITION BY subject_id, slot ORDER BY rn > 60, coalesce(confidence, -1) DESC, value_id) AS k FROM n) SELECT value_id, k = 1 AND coalesce(confidence >= 0.6, false) AS winner, confidence, n FROM t""")
def e11_contested(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").filter("value_type = 'money'").select("value_id", "subject_id", "slot", "confidence").dropDuplicates(["value_id"])
    return grounding.contested(v, ["subject_id", "slot"], "value_id")


@query("WITH f AS (SELECT DISTINCT fact_id, source_id, property, value, subject_quote, slot, context_quote FROM extracted_facts), k AS (SELECT *, lower(regexp_replace(value, '[^\\p{L}\\p{N}]', '', 'g')) AS v, lower(regexp_replace(subject_quote, '[^\\p{L}\\p{N}]', '', 'g')) AS s FROM f) SELECT source_id, property, min(fact_id) AS fact_id, count(*) AS n FROM k WHERE v IS NOT NULL GROUP BY source_id, property, v, s")
def e3_merge_same(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_facts").select("fact_id", "source_id", "property", "value", "subject_quote", "slot", "context_quote")
    return grounding.merge_same(f).select("source_id", "property", "fact_id", "n")


@query("""WITH r AS (SELECT source_id, slot, 0 AS priority, min(value_id) AS value_id FROM slot_values WHERE value_checked AND source_id IS NOT NULL GROUP BY ALL UNION ALL SELECT source_id, slot, 1, min(value_id) FROM slot_values WHERE NOT coalesce(value_checked, false) AND source_id IS NOT NULL GROUP BY ALL)
  SELECT source_id, slot, min_by(value_id, priority) AS value_id, min(priority) AS priority FROM r GROUP BY ALL""")
def e13_profile(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").filter("source_id is not null").select("source_id", "slot", "value_id", "value_checked").dropDuplicates(["value_id"])
    ok = F.coalesce("value_checked", F.lit(False))
    return grounding.first_by_priority(v.filter(ok), v.filter(~ok), keys=["source_id", "slot"], order="value_id").select("source_id", "slot", "value_id", "priority")


@query("SELECT source_id, min(period) AS period FROM slot_values WHERE period IS NOT NULL AND source_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT period) = 1")
def e14_shared_period(spark: SparkSession, d: str) -> DataFrame:
    return grounding.document_currency(table(spark, d, "slot_values").select("source_id", "period"), currency="period")


@query("SELECT DISTINCT value_id, CASE WHEN check_flag IS NULL THEN 'unverified' WHEN slot IS NULL THEN 'uninterpreted' WHEN value_checked THEN 'verified' ELSE 'uncertain' END AS state FROM slot_values")
def e16_fact_state(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values")
    return v.select("value_id", grounding.fact_state(F.when(F.col("value_checked"), "accept").otherwise("check"), F.col("check_flag").isNotNull(), F.col("slot").isNotNull()).alias("state")).distinct()


@query("""WITH f AS (SELECT DISTINCT fact_id, subject_id, lower(property) AS property, value, conflict FROM data_facts), g AS (SELECT subject_id, property, count(*) AS n, count(DISTINCT value) AS d, count(CASE WHEN coalesce(conflict, false) THEN 1 END) AS open FROM f GROUP BY ALL)
  SELECT subject_id, property, n, CASE WHEN n > 10 THEN 'incomplete' WHEN d > 1 THEN 'conflicting' WHEN d = 1 AND open = 0 THEN 'resolved' WHEN d = 1 THEN 'unverified' ELSE 'missing' END AS status FROM g""")
def x26_fact_status(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "data_facts").select("fact_id", "subject_id", F.lower("property").alias("property"), "value", "conflict").dropDuplicates(["fact_id"])
    g = f.groupBy("subject_id", "property").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"), F.count_if(F.coalesce("conflict", F.lit(False))).alias("open"))
    status = F.when(F.col("n") > 10, "incomplete").when(F.col("d") > 1, "conflicting").when((F.col("d") == 1) & (F.col("open") == 0), "resolved").when(F.col("d") == 1, "unverified").otherwise("missing")
    return g.select("subject_id", "property", "n", status.alias("status"))


@query("""WITH a AS (SELECT DISTINCT value_id, subject_id, slot, confidence FROM slot_values WHERE check_flag), e AS (SELECT DISTINCT entity_id, label FROM entities WHERE deleted_at IS NULL) SELECT entity_id, label, count(*) AS n, string_agg(CAST(value_id AS VARCHAR), ',' ORDER BY value_id) AS checks FROM a JOIN e ON entity_id = subject_id GROUP BY ALL""")
def x22_quick_checks(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "slot_values").filter("check_flag").select("value_id", F.col("subject_id").alias("entity_id")).dropDuplicates(["value_id"])
    e = table(spark, d, "entities").filter("deleted_at is null").select("entity_id", "label").distinct()
    g = a.join(e, "entity_id").groupBy("entity_id", "label").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("value_id")).alias("ids"))
    return g.select("entity_id", "label", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("checks"))


@query("""WITH k AS (SELECT DISTINCT fact_id, subject_id, property, value, recent FROM data_facts WHERE recent > 0), r AS (SELECT *, row_number() OVER (ORDER BY recent DESC, fact_id) AS n FROM k) SELECT fact_id, n FROM r WHERE n <= 64""")
def l5_recents(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "data_facts").filter("recent > 0").select("fact_id", "recent").dropDuplicates(["fact_id"]).orderBy(F.desc("recent"), "fact_id").limit(64)
    return k.select("fact_id", F.row_number().over(Window.orderBy(F.desc("recent"), "fact_id")).cast("long").alias("n"))


@query("""WITH k AS (SELECT vault, source_id, min_by(text, ordinal) AS first FROM parts WHERE text IS NOT NULL GROUP BY ALL) SELECT source_id, vault, substr(first, 1, 2000) AS excerpt FROM k""")
def l8_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").filter("text is not null").groupBy("vault", "source_id").agg(F.min_by("text", "ordinal").alias("first")).select("source_id", "vault", F.substring("first", 1, 2000).alias("excerpt"))


@query("""WITH f AS (SELECT DISTINCT subject_id, lower(trim(property, E' \\t\\n\\r')) AS property, value FROM data_facts WHERE NOT coalesce(conflict, false) AND value IS NOT NULL) SELECT subject_id, property, min(value) AS value FROM f GROUP BY ALL HAVING count(*) = 1""")
def s18_hand_off(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "data_facts").filter(~F.coalesce("conflict", F.lit(False)) & F.col("value").isNotNull())
    f = f.select("subject_id", F.regexp_replace(F.lower("property"), r"^\s+|\s+$", "").alias("property"), "value")
    return f.groupBy("subject_id", "property").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n")).filter("n = 1").drop("n")


@query("""WITH e AS (SELECT subject_id AS s, source_id AS t FROM slot_values WHERE source_id IS NOT NULL GROUP BY ALL) SELECT s AS entity_id, count(*) AS sources FROM e GROUP BY 1""")
def x42_sources_of_entity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slot_values").filter("source_id is not null").groupBy(F.col("subject_id").alias("entity_id")).agg(F.count_distinct("source_id").alias("sources"))


@query("""WITH p AS (SELECT DISTINCT fact_id, segment_id, quote, context_quote FROM extracted_facts WHERE context_quote IS NOT NULL AND quote IS NOT NULL), s AS (SELECT DISTINCT segment_id, text FROM parts)
  SELECT fact_id, contains(text, quote) AS quote_there, contains(text, context_quote) AS context_there FROM p JOIN s USING (segment_id)""")
def x43_proposals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "extracted_facts").filter("context_quote is not null and quote is not null").select("fact_id", "segment_id", "quote", "context_quote").dropDuplicates(["fact_id"])
    s = table(spark, d, "parts").select("segment_id", "text").dropDuplicates(["segment_id"])
    return p.join(s, "segment_id").select("fact_id", F.contains("text", "quote").alias("quote_there"), F.contains("text", "context_quote").alias("context_there"))


@query("""WITH x AS (SELECT DISTINCT value_id, subject_id, slot, coalesce(value_text, amount) AS value FROM slot_values WHERE value_type IN ('identifier', 'text')) SELECT value_id, sha256('{"c0":"' || subject_id || '","c1":"' || slot || '","c2":"' || value || '"}') AS key FROM x WHERE value IS NOT NULL AND value NOT LIKE '%"%' AND value NOT LIKE '%\\%' ESCAPE '!'""")
def v20_semantic_key(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier and text with a value; the SQL leaves out those that JSON would escape."""
    x = table(spark, d, "slot_values").filter("value_type in ('identifier', 'text')").select("value_id", "subject_id", "slot", F.coalesce("value_text", "amount").alias("value")).dropDuplicates(["value_id"])
    x = x.filter("value is not null")
    return x.select("value_id", scalars.semantic_key(F.col("subject_id"), F.col("slot"), F.col("value")).alias("key"))
