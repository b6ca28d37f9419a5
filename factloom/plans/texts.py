"""Queries on texts, scalars and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import grounding, scan, search
from factloom.plans.registry import query
from factloom.sources.tables import table


@query()
def k_candidates(spark: SparkSession, d: str) -> DataFrame:
    return scan.candidates(table(spark, d, "parts"), "segment_id", "text")


@query()
def k_kinds(spark: SparkSession, d: str) -> DataFrame:
    c = scan.candidates(table(spark, d, "parts"), "segment_id", "text")
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("checksum").alias("checked"), F.count("label").alias("labelled"))


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}')) AS email FROM documents")
def k17_emails(spark: SparkSession, d: str) -> DataFrame:
    return scan.emails(table(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9.-])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?:\b)', 1)) AS t FROM documents),
  p AS (SELECT doc_id, CASE WHEN t LIKE '____-__-__' THEN try_strptime(t, '%Y-%m-%d') ELSE try_strptime(t, '%d.%m.%Y') END::DATE AS day FROM x)
  SELECT doc_id, CAST(day AS VARCHAR) AS day, count(*) AS n FROM p WHERE day IS NOT NULL GROUP BY ALL""")
def k6_dates(spark: SparkSession, d: str) -> DataFrame:
    return scan.dates(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("day").cast("string").alias("day"), "n")


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]{1,3}-[0-9]{6,9}')) AS identifier FROM documents")
def k10_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z]{1,3}-[0-9]{6,9}"), F.lit(0))).alias("identifier"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9][.,][0-9]{2} ?€')) AS euros FROM documents WHERE text IS NOT NULL")
def k8_euro_amounts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9][.,][0-9]{2} ?€"), F.lit(0))).cast("long").alias("euros"))


@query()
def s12_segments(spark: SparkSession, d: str) -> DataFrame:
    return scan.segments(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT source_id, ordinal, text FROM (SELECT DISTINCT segment_id, source_id, ordinal, text FROM parts) UNION ALL SELECT source_id, 0, title FROM (SELECT DISTINCT source_id, title FROM sources) WHERE trim(title) <> ''")
def s14_titles(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "parts").select("segment_id", "source_id", "ordinal", "text").dropDuplicates(["segment_id"])
    return scan.with_titles(parts, table(spark, d, "sources").select("source_id", "title").distinct(), "source_id")


_TS = r"regexp_extract_all(translate(lower(text), 'äöüàáâãåèéêëìíîïòóôõùúûýÿñç', 'aouaaaaaeeeeiiiioooouuuyync'), '[a-z0-9]+')"


@query(f"WITH t AS (SELECT doc_id AS id, unnest({_TS}) AS term FROM documents), p AS (SELECT id, term, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM p GROUP BY 1")
def s15_index_terms(spark: SparkSession, d: str) -> DataFrame:
    p = search.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query(f"""WITH t AS (SELECT doc_id AS id, {_TS} AS ts FROM documents WHERE text IS NOT NULL), h AS (SELECT id, len(ts) AS l, len(list_filter(ts, lambda x: starts_with(x, 'miet'))) AS a, len(list_filter(ts, lambda x: starts_with(x, 'heizung'))) AS b FROM t),
  s AS (SELECT count(*) AS n, avg(l) AS av, sum((a > 0)::INT) AS da, sum((b > 0)::INT) AS db FROM h),
  r AS (SELECT id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / av)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / av)), 6) AS score FROM h, s WHERE a > 0 AND b > 0)
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r ORDER BY score DESC, id LIMIT 30""")
def fts_search(spark: SparkSession, d: str) -> DataFrame:
    r = search.search(search.index_of(table(spark, d, "documents"), "doc_id", "text", d), "Miet Heizung")
    return r.select("id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH t AS (SELECT doc_id AS id, text, translate(lower(text), 'äöüàáâãåèéêëìíîïòóôõùúûýÿñç', 'aouaaaaaeeeeiiiioooouuuyync') AS p, {_TS} AS ts FROM documents WHERE text IS NOT NULL), h AS (SELECT id, text, p, len(ts) AS l, len(list_filter(ts, lambda x: starts_with(x, 'kundig'))) AS a FROM t),
  s AS (SELECT count(*) AS n, avg(l) AS av, sum((a > 0)::INT) AS da FROM h), r AS (SELECT id, text, p, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / av)), 6) AS score FROM h, s WHERE a > 0),
  k AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () > 5 AS more FROM r)
  SELECT id, rank, more, substr(text, greatest(length(regexp_extract(p, '^(.*?(?:^|[^a-z0-9]))kundig', 1, 's')) + 1 - 100, 1)::BIGINT, 500) AS excerpt FROM k WHERE rank <= 5""")
def fts_excerpts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hits = search.search(search.index_of(docs, "doc_id", "text", d), "Kündig", 5).select("id", F.col("rank").cast("long").alias("rank"), "more")
    return search.excerpts(hits, docs, "doc_id", "text", "Kündig")


@query(r"SELECT DISTINCT name, trim(regexp_replace(replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM issuers")
def v1_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "issuers").select("name", scalars.normalize_name(F.col("name")).alias("norm")).distinct()


@query(r"SELECT DISTINCT issuer_id, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(lower(name), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')), '( (gmbh|ag|kg|eg|se|co|ohg|ug|mbh|ltd|inc|llc|plc|sa|sarl|sl))+$', '') AS norm FROM issuers")
def v2_organizations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "issuers").select("issuer_id", scalars.normalize_organization(F.col("name")).alias("norm")).distinct()


@query(r"SELECT DISTINCT value_id, upper(regexp_replace(value_text, '[^\p{L}\p{N}]', '', 'g')) AS norm FROM slot_values WHERE value_type = 'identifier'")
def v3_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slot_values").filter("value_type = 'identifier'").select("value_id", scalars.normalize_identifier(F.col("value_text")).alias("norm")).distinct()


@query(r"""WITH x AS (SELECT DISTINCT value_id, amount FROM slot_values), y AS (SELECT value_id, regexp_matches(amount, '^[+-]?[0-9]+(\.[0-9]+)?$') AS ok, regexp_replace(regexp_replace(regexp_replace(regexp_replace(amount, '^\+', ''), '(\.[0-9]*?)0+$', '\1'), '\.$', ''), '^(-?)0+([0-9])', '\1\2') AS c FROM x)
  SELECT value_id, CASE WHEN ok THEN CASE WHEN c = '-0' THEN '0' ELSE c END END AS canonical FROM y""")
def v6_decimals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "slot_values").select("value_id", scalars.canonical_decimal(F.col("amount")).alias("canonical")).distinct()


@query(r"""WITH x AS (SELECT DISTINCT fact_id, value FROM data_facts) SELECT fact_id, CAST(CASE WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN try_strptime(value, '%Y-%m-%d')::DATE WHEN regexp_matches(value, '^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$') THEN try_strptime(value, '%d.%m.%Y')::DATE END AS VARCHAR) AS day FROM x""")
def v7_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "data_facts").select("fact_id", scalars.parse_date(F.col("value")).cast("string").alias("day")).distinct()


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate)::DATE AS VARCHAR) AS first, CAST(last_day(o_orderdate) AS VARCHAR) AS last, 'month' AS whole FROM orders")
def v9_periods(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select("o_orderkey", scalars.month_period(F.to_date("o_orderdate")).alias("p"))
    return p.select("o_orderkey", F.col("p.first").cast("string").alias("first"), F.col("p.last").cast("string").alias("last"), scalars.whole_period(F.col("p.first"), F.col("p.last")).alias("whole"))


@query("""WITH x AS (SELECT c_custkey AS k, 'DE' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey * 7919 AS VARCHAR), 18, '0') AS iban FROM customer), n AS (SELECT k, iban, CAST(substr(iban, 5) || '1314' || substr(iban, 3, 2) AS HUGEINT) % 97 = 1 AS ok FROM x) SELECT k, iban, ok FROM n""")
def v10_iban(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    iban = F.concat(F.lit("DE"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k * 7919).cast("string"), 18, "0"))
    return table(spark, d, "customer").select(k.alias("k"), iban.alias("iban"), scalars.valid_iban(iban).alias("ok"))


@query("SELECT p_partkey, length(p_name) AS n, (7 * (ascii(substr(p_brand, 1, 1)) - 55) + 3 * (ascii(upper(substr(p_brand, 2, 1))) - 55)) % 10 AS digit FROM part WHERE length(p_brand) > 1")
def v13_check_digit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("length(p_brand) > 1").select("p_partkey", F.length("p_name").cast("long").alias("n"), scalars.mrz_digit(F.upper(F.substring("p_brand", 1, 2))).cast("long").alias("digit"))


@query("SELECT event_id, (abs(a) + abs(b) + abs(a + b)) // 2 AS distance FROM (SELECT event_id, user_id % 17 - 8 AS a, event_id % 13 - 6 AS b FROM events)")
def v19_hex_distance(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("user_id") % 17 - 8, F.col("event_id") % 13 - 6
    return table(spark, d, "events").select("event_id", scalars.hex_distance(a, b, F.lit(0), F.lit(0)).cast("long").alias("distance"))


@query("SELECT doc_id, substr(split_part(text, chr(10), 1), 1, 60) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, length(split_part(text, chr(10), 1)) + 2) ELSE '' END AS body FROM documents WHERE text IS NOT NULL AND text NOT LIKE '%' || chr(769) || '%'")
def v23_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a text; the SQL leaves out those that hold a combining acute."""
    n = table(spark, d, "documents").filter("text is not null")
    return n.select("doc_id", scalars.quick_note(F.col("text")).alias("n")).select("doc_id", "n.title", "n.body")


@query(r"SELECT DISTINCT login_id, nullif(regexp_extract(lower(website), '^[a-z][a-z0-9+.-]*://(?:www\.)?([a-z0-9.-]+)', 1), '') AS host FROM logins")
def v25_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "logins").select("login_id", scalars.url_host(F.col("website")).alias("host")).distinct()


@query(r"""WITH s AS (SELECT DISTINCT segment_id, text FROM parts), f AS (SELECT DISTINCT fact_id, segment_id, quote FROM extracted_facts WHERE quote IS NOT NULL) SELECT fact_id, contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS spaced FROM f JOIN s USING (segment_id)""")
def e1_quote(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "parts").select("segment_id", "text").dropDuplicates(["segment_id"])
    f = table(spark, d, "extracted_facts").filter("quote is not null").select("fact_id", "segment_id", "quote").dropDuplicates(["fact_id"])
    return f.join(s, "segment_id").select("fact_id", F.contains(grounding.squeeze(F.col("text")), grounding.squeeze(F.col("quote"))).alias("spaced"))


@query()
def e1_whole_span(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "parts").select("segment_id", "text").dropDuplicates(["segment_id"])
    f = table(spark, d, "extracted_facts").filter("quote is not null").select("fact_id", "segment_id", "quote").dropDuplicates(["fact_id"])
    return f.join(s, "segment_id").select("fact_id", grounding.grounded(F.col("quote"), F.col("text")).alias("how"))


@query()
def e8_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Candidates worth reading that no quote covers."""
    s = table(spark, d, "parts").select("segment_id", "text").dropDuplicates(["segment_id"])
    c = scan.candidates(s, "segment_id", "text").filter(F.coalesce("checksum", F.lit(False)) | (F.col("kind").isin("money", "date") & F.col("label").isNotNull()))
    f = table(spark, d, "extracted_facts").filter("quote is not null").select("segment_id", "quote").distinct()
    spans = f.join(s, "segment_id").select("segment_id", grounding.locate(F.col("quote"), F.col("text")).alias("l")).filter("l is not null").select("segment_id", "l.start", "l.end")
    return grounding.uncovered(c, spans)
