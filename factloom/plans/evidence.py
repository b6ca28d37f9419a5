"""Queries on assembly: checked writes, typing, batches, equivalents, retrieval, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import assembly, filters, grounding, scan, search
from factloom.plans.facts import _A, _CLOSED, DAY, assertions, closed
from factloom.plans.registry import query
from factloom.sources.tables import checkpoint, table


@query(f"""WITH {_CLOSED} SELECT value_id, CASE WHEN value_type = 'date' THEN 'timeless' WHEN confidence IS NULL THEN 'unknown' ELSE 'interval' END AS kind FROM c
  WHERE value_type = 'date' OR confidence IS NULL OR (valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR DATE '{DAY}' < valid_to))""")
def f2_currently_valid(spark: SparkSession, d: str) -> DataFrame:
    c = closed(spark, d).withColumn("kind", F.when(F.col("value_type") == "date", "timeless").when(F.col("confidence").isNull(), "unknown").otherwise("interval"))
    return c.filter(filters.effective(F.col("kind"), F.col("valid_from"), F.col("valid_to"), F.lit(DAY).cast("date"))).select("value_id", "kind")


@query(f"WITH {_A}, g AS (SELECT subject_id, slot, period, currency, count(*) AS n FROM a GROUP BY ALL) SELECT a.value_id, g.n FROM a JOIN g ON a.subject_id IS NOT DISTINCT FROM g.subject_id AND a.slot IS NOT DISTINCT FROM g.slot AND a.period IS NOT DISTINCT FROM g.period AND a.currency IS NOT DISTINCT FROM g.currency")
def f7_null_safe(spark: SparkSession, d: str) -> DataFrame:
    a = assertions(spark, d).select("value_id", "subject_id", "slot", "period", "currency")
    keys = ["subject_id", "slot", "period", "currency"]
    g = a.groupBy(*keys).agg(F.count("*").alias("n"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"g.{k}"))
    return a.alias("a").join(g.alias("g"), on).select("value_id", "n")


@query("""WITH s AS (SELECT DISTINCT source_id, kind, title FROM sources), p AS (SELECT source_id, count(DISTINCT segment_id) AS parts FROM parts GROUP BY 1), f AS (SELECT source_id, count(DISTINCT fact_id) AS facts FROM extracted_facts GROUP BY 1), v AS (SELECT source_id, count(DISTINCT value_id) AS n_values FROM slot_values GROUP BY 1)
  SELECT source_id, kind, coalesce(parts, 0) AS parts, coalesce(facts, 0) AS facts, coalesce(n_values, 0) AS n_values FROM s LEFT JOIN p USING (source_id) LEFT JOIN f USING (source_id) LEFT JOIN v USING (source_id)""")
def w5_import_list(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("source_id", "kind", "title").distinct()
    for t, k, n in (("parts", "segment_id", "parts"), ("extracted_facts", "fact_id", "facts"), ("slot_values", "value_id", "n_values")):
        s = s.join(table(spark, d, t).groupBy("source_id").agg(F.count_distinct(k).alias(n)), "source_id", "left")
    return s.select("source_id", "kind", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("parts", "facts", "n_values")])


@query(f"""WITH {_A}, n AS (SELECT * FROM a WHERE value IS NOT NULL) SELECT subject_id, slot, count(DISTINCT value) AS n_values, min_by(value_id, (value, value_id)) AS first, max_by(value_id, (value, -value_id)) AS other FROM n GROUP BY ALL HAVING count(DISTINCT value) > 1""")
def j9_disagreeing(spark: SparkSession, d: str) -> DataFrame:
    return assembly.disagreeing(assertions(spark, d), ["subject_id", "slot"], "value", "value_id")


@query(f"""WITH {_A}, n AS (SELECT value_id, subject_id, slot, lower(regexp_replace(value, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS v FROM a), g AS (SELECT subject_id, slot, v, min(value_id) AS keep FROM n WHERE v <> '' GROUP BY ALL) SELECT value_id, keep FROM n JOIN g USING (subject_id, slot, v)""")
def x23_equivalents(spark: SparkSession, d: str) -> DataFrame:
    return assembly.equivalents(assertions(spark, d), ["subject_id", "slot"], "value", "value_id")


@query(f"""WITH {_A}, p AS (SELECT slot, min(value_type) AS t FROM a GROUP BY 1), k AS (SELECT a.*, trim(regexp_replace(value, '\\s+', ' ', 'g')) AS v FROM a), f AS (SELECT subject_id, slot, v, valid_from, min(value_id) AS first FROM k GROUP BY ALL)
  SELECT value_id, CASE WHEN t IS NULL THEN 'unknown_property' WHEN t <> value_type THEN 'wrong_type' WHEN k.v IS NULL OR k.v = '' THEN 'no_value' WHEN first <> value_id THEN 'repeated' ELSE 'ok' END AS verdict
  FROM k LEFT JOIN p USING (slot) JOIN f ON f.subject_id IS NOT DISTINCT FROM k.subject_id AND f.slot IS NOT DISTINCT FROM k.slot AND f.v IS NOT DISTINCT FROM k.v AND f.valid_from IS NOT DISTINCT FROM k.valid_from""")
def x5_checked_writes(spark: SparkSession, d: str) -> DataFrame:
    a = assertions(spark, d)
    p = a.groupBy("slot").agg(F.min("value_type").alias("value_type"))
    return assembly.checked_writes(a.select("value_id", "subject_id", "slot", "value", "value_type", "valid_from"), p).select("value_id", "verdict")


@query(r"""WITH x AS (SELECT DISTINCT value_id, value_type, value_text AS t FROM slot_values WHERE value_type IN ('date', 'identifier', 'text')) SELECT value_id, CASE value_type WHEN 'date' THEN CAST(CASE WHEN regexp_matches(trim(t), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(trim(t), '%Y-%m-%d')::DATE WHEN regexp_matches(trim(t), '^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$') THEN try_strptime(trim(t), '%d.%m.%Y')::DATE END AS VARCHAR)
  WHEN 'identifier' THEN nullif(upper(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')), '') ELSE nullif(trim(regexp_replace(t, '\s+', ' ', 'g')), '') END AS typed FROM x""")
def e6_typed(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "slot_values").filter("value_type in ('date', 'identifier', 'text')").select("value_id", "value_type", "value_text").dropDuplicates(["value_id"])
    return v.select("value_id", assembly.typed(F.col("value_type"), F.col("value_text")).alias("typed"))


@query(r"SELECT DISTINCT fact_id, coalesce(regexp_matches(value, '[0-9]\s?(?:€|EUR|Euro|\$|USD|£|GBP|CHF|Fr\.|zł|Kč|DM)|(?:€|EUR|US\$|£|Fr\.|zł|Kč|DM)\s?[0-9]'), false) AS money FROM data_facts")
def e7_looks_like_money(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_facts").select("fact_id", assembly.looks_like_money(F.col("value")).alias("money")).distinct()


@query("WITH x AS (SELECT l_orderkey, l_linenumber, [l_discount, 1 - l_discount] AS p FROM lineitem) SELECT l_orderkey, l_linenumber, p[1] BETWEEN 0 AND 1 AND p[2] BETWEEN 0 AND 1 AND abs(p[1] + p[2] - 1) <= 0.01 AND p[1 + l_linenumber % 2] = greatest(p[1], p[2]) AS ok FROM x")
def e12_answers(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    p = F.array(F.col("l_discount"), 1 - F.col("l_discount"))
    return l.select("l_orderkey", "l_linenumber", assembly.valid_answer(p, (1 + F.col("l_linenumber") % 2).cast("int")).alias("ok"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 THEN 0 WHEN l_returnflag = 'R' THEN -abs(l_extendedprice) ELSE abs(l_extendedprice) END AS amount FROM lineitem")
def e15_refund_sign(spark: SparkSession, d: str) -> DataFrame:
    direction = F.when(F.col("l_returnflag") == "R", "refund").otherwise("payment")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", grounding.refund_sign(F.col("l_extendedprice"), direction).alias("amount"))


@query()
def l9_batches(spark: SparkSession, d: str) -> DataFrame:
    return assembly.batches(table(spark, d, "documents"), "doc_id", "source", "text", salts=16)


@query()
def l10_sections(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parts").select("segment_id", "source_id", "text").dropDuplicates(["segment_id"])
    return assembly.sections(p, "segment_id", "source_id", "text", 1200)


@query("SELECT DISTINCT source_id, title, vault FROM sources WHERE title IS NOT NULL ORDER BY lower(title), source_id LIMIT 50")
def l3_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter("title is not null").select("source_id", "title", "vault").distinct()
    return s.orderBy(F.lower("title"), "source_id").limit(50)


@query("WITH l AS (SELECT DISTINCT login_id, favorite, revision FROM logins) SELECT login_id, favorite FROM l ORDER BY favorite DESC, login_id DESC LIMIT 200")
def l2_pinned_first(spark: SparkSession, d: str) -> DataFrame:
    return assembly.page(table(spark, d, "logins").select("login_id", "favorite").distinct(), [F.desc("favorite"), F.desc("login_id")], 200)[0]


@query(r"SELECT DISTINCT fact_id, regexp_replace(lower(value), '[^\p{L}\p{N}]', '', 'g') AS compact FROM data_facts")
def v4_compact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_facts").select("fact_id", filters.compact(F.col("value")).alias("compact")).distinct()


@query("SELECT o_orderkey, CAST(o_orderdate::DATE + 1 AS VARCHAR) AS next FROM orders")
def v8_next_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 1).cast("string").alias("next"))


@query("""WITH RECURSIVE x AS (SELECT c_custkey AS k, lpad(CAST((10000000000 + c_custkey * 8191) % 100000000000 AS VARCHAR), 11, '0') AS id FROM customer), s AS (SELECT k, id, 0 AS i, 10 AS p FROM x UNION ALL SELECT k, id, i + 1, ((CASE WHEN (CAST(substr(id, i + 1, 1) AS INT) + p) % 10 = 0 THEN 10 ELSE (CAST(substr(id, i + 1, 1) AS INT) + p) % 10 END) * 2) % 11 FROM s WHERE i < 10),
  e AS (SELECT k, id, p FROM s WHERE i = 10), c AS (SELECT k, id, p, list_transform(range(10), lambda d: 10 - length(replace(substr(id, 1, 10), CAST(d AS VARCHAR), ''))) AS n FROM e)
  SELECT k, id, regexp_matches(id, '^[1-9][0-9]{10}$') AND len(list_filter(n, lambda y: y > 1)) = 1 AND list_max(n) <= 3 AND NOT regexp_matches(substr(id, 1, 10), '000|111|222|333|444|555|666|777|888|999') AND (CASE WHEN 11 - p = 10 THEN 0 ELSE (11 - p) % 10 END) = CAST(substr(id, 11, 1) AS INT) AS ok FROM c""")
def v11_tax_ids(spark: SparkSession, d: str) -> DataFrame:
    id = F.lpad(((F.lit(10000000000) + F.col("c_custkey") * 8191) % 100000000000).cast("string"), 11, "0")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), id.alias("id"), scalars.valid_tax_id(id).alias("ok"))


@query(r"SELECT DISTINCT label, CASE regexp_replace(lower(label), '[^\p{L}\p{N}]', '', 'g') WHEN 'strasse' THEN 'street' WHEN 'straße' THEN 'street' WHEN 'street' THEN 'street' WHEN 'adresse' THEN 'street' WHEN 'address' THEN 'street' WHEN 'plz' THEN 'postal_code' WHEN 'postleitzahl' THEN 'postal_code' WHEN 'zip' THEN 'postal_code' WHEN 'ort' THEN 'city' WHEN 'stadt' THEN 'city' WHEN 'city' THEN 'city' END AS field FROM data_facts WHERE label IS NOT NULL")
def v18_standard_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_facts").filter("label is not null").select("label", scalars.standard_field(F.col("label")).alias("field")).distinct()


@query("SELECT DISTINCT segment_id, array_to_string(string_split(text, chr(10))[1:12], chr(10)) AS head FROM parts WHERE text IS NOT NULL")
def v22_letterhead(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parts").filter("text is not null").select("segment_id", F.array_join(F.slice(F.split("text", "\n"), 1, 12), "\n").alias("head")).distinct()


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN event_id - 3 END AS supersedes, event_id % 2 = 0 AS accepted FROM events), s AS (SELECT supersedes AS old, min(id) AS by_id FROM r WHERE accepted AND supersedes IS NOT NULL GROUP BY 1) SELECT id, CAST(CASE WHEN accepted THEN id ELSE by_id END AS VARCHAR) AS current FROM r LEFT JOIN s ON old = id""")
def x20_current(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    r = table(spark, d, "events").select(e.alias("id"), F.when(e % 5 == 0, e - 3).alias("supersedes"), (e % 2 == 0).alias("accepted"))
    return assembly.current(r).withColumn("current", F.col("current").cast("string"))


@query("""WITH f AS (SELECT DISTINCT fact_id, source_id, segment_id, property, slot, quote FROM extracted_facts), p AS (SELECT DISTINCT segment_id, page, section, method FROM parts) SELECT fact_id, CASE WHEN trim(slot) <> '' AND slot <> 'none' THEN 'in_profile' WHEN quote IS NOT NULL THEN 'other' ELSE 'uninterpreted' END AS bucket, coalesce('Page ' || CAST(CAST(page AS INT) AS VARCHAR), section, 'Source') || CASE WHEN lower(coalesce(method, '')) = 'ocr' THEN ' (OCR)' ELSE '' END AS place FROM f LEFT JOIN p USING (segment_id)""")
def x28_read_view(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "extracted_facts").select("fact_id", "segment_id", "slot", "quote").dropDuplicates(["fact_id"])
    p = table(spark, d, "parts").select("segment_id", "page", "section", "method").dropDuplicates(["segment_id"])
    bucket = F.when((F.trim("slot") != "") & (F.col("slot") != "none"), "in_profile").when(F.col("quote").isNotNull(), "other").otherwise("uninterpreted")
    return f.join(p, "segment_id", "left").select("fact_id", bucket.alias("bucket"), filters.location(F.col("page"), F.col("section"), F.col("method")).alias("place"))


@query(f"""WITH {_A}, r AS (SELECT subject_id, slot, value_id, CAST(valid_from AS VARCHAR) AS day, row_number() OVER (PARTITION BY subject_id, slot ORDER BY valid_from DESC, value_id DESC) AS n FROM a) SELECT subject_id, slot, value_id, day, n FROM r WHERE n <= 100""")
def x33_history(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("subject_id", "slot").orderBy(F.desc("valid_from"), F.desc("value_id"))
    a = assertions(spark, d).select("subject_id", "slot", "value_id", "valid_from").withColumn("n", F.row_number().over(w)).filter("n <= 100")
    return a.select("subject_id", "slot", "value_id", F.col("valid_from").cast("string").alias("day"), F.col("n").cast("long").alias("n"))


@query()
def x35_retrieval(spark: SparkSession, d: str) -> DataFrame:
    p = checkpoint(table(spark, d, "parts").select("segment_id", "source_id", "text").dropDuplicates(["segment_id"]))
    hits, index = None, search.index_of(p, "segment_id", "text", d)
    for k, text in enumerate(("Miete", "Heizung Wartung", "contract")):
        h = search.search(index, text, 6).select(F.col("id").alias("segment_id"), F.lit(k).alias("query_no"), "rank")
        hits = h if hits is None else hits.unionByName(h)
    return assembly.retrieval(hits.join(p.select("segment_id", "source_id"), "segment_id"))


@query("""WITH n AS (SELECT vault, subject_name AS name, count(*) AS n FROM (SELECT DISTINCT vault, source_id, subject_name FROM classifications WHERE trim(subject_name) <> '') GROUP BY ALL) SELECT vault, string_agg(name, '|' ORDER BY name) AS names FROM n WHERE n >= 2 GROUP BY 1""")
def x40_anchors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "classifications").filter("trim(subject_name) <> ''").groupBy("vault", "subject_name").agg(F.count_distinct("source_id").alias("n")).filter("n >= 2")
    return n.groupBy("vault").agg(F.array_join(F.sort_array(F.collect_list("subject_name")), "|").alias("names"))


@query("""WITH p AS (SELECT DISTINCT fact_id, subject_id, lower(trim(property, E' \\t\\n\\r')) AS property, value FROM data_facts WHERE coalesce(conflict, false)), a AS (SELECT subject_id, lower(trim(property, E' \\t\\n\\r')) AS property, count(DISTINCT value) AS n FROM data_facts WHERE NOT coalesce(conflict, false) AND value IS NOT NULL GROUP BY ALL) SELECT fact_id, coalesce(n, 0) AS accepted_values FROM p LEFT JOIN a USING (subject_id, property)""")
def x44_proposals(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "data_facts").select("fact_id", "subject_id", F.regexp_replace(F.lower("property"), r"^\s+|\s+$", "").alias("property"), "value", F.coalesce("conflict", F.lit(False)).alias("conflict"))
    a = f.filter("not conflict and value is not null").groupBy("subject_id", "property").agg(F.count_distinct("value").alias("n"))
    return f.filter("conflict").dropDuplicates(["fact_id"]).join(a, ["subject_id", "property"], "left").select("fact_id", F.coalesce("n", F.lit(0)).alias("accepted_values"))


@query("""WITH t AS (SELECT DISTINCT segment_id, text FROM parts WHERE source_id IN (SELECT source_id FROM sources WHERE sensitivity = 'personal' AND retention = 'keep') AND text IS NOT NULL) SELECT segment_id, octet_length(encode(text)) AS bytes FROM t WHERE octet_length(encode(text)) <= 18000""")
def x46_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").filter(filters.visible(F.col("sensitivity"), F.col("retention"))).select("source_id")
    p = table(spark, d, "parts").filter("text is not null").join(s, "source_id", "left_semi").select("segment_id", F.octet_length("text").cast("long").alias("bytes")).distinct()
    return p.filter("bytes <= 18000")


@query("""WITH n AS (SELECT vault, property, value FROM (SELECT DISTINCT e.vault, lower(trim(f.property, E' \\t\\n\\r')) AS property, f.value FROM data_facts f JOIN (SELECT DISTINCT entity_id, vault FROM entities) e ON f.subject_id = e.entity_id WHERE f.value IS NOT NULL)) SELECT vault, property, min(value) AS value FROM n GROUP BY ALL HAVING count(*) = 1""")
def x50_form_needs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select(F.col("entity_id").alias("subject_id"), "vault").distinct()
    f = table(spark, d, "data_facts").filter("value is not null").select("subject_id", F.regexp_replace(F.lower("property"), r"^\s+|\s+$", "").alias("property"), "value")
    n = f.join(e, "subject_id").groupBy("vault", "property").agg(F.min("value").alias("value"), F.max("value").alias("hi"))
    return n.filter("value = hi").drop("hi")


@query("SELECT kind, concat_ws(' ', kind, CAST(count(DISTINCT source_id) AS VARCHAR), 'sources') AS line FROM sources GROUP BY 1")
def w12_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").groupBy("kind").agg(F.count_distinct("source_id").alias("n")).select("kind", F.concat_ws(" ", "kind", F.col("n").cast("string"), F.lit("sources")).alias("line"))


@query()
def s13_raw_segments(spark: SparkSession, d: str) -> DataFrame:
    return scan.segments(table(spark, d, "documents"), "doc_id", "text", 1600, at_lines=False)


@query("SELECT max(recent) + 1 AS next_recent FROM data_facts")
def g11_next_sequence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_facts").agg((F.max("recent") + 1).alias("next_recent"))
