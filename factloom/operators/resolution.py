"""From typed values to entities, assertions and links, and the logs around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roman numerals that name a category (classes, levels), by rule.
ROMAN = {r: str(n) for n in range(1, 40) for r in ("X" * (n // 10) + ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")[n % 10],)}

#: Shape of a login's details: fields with a designation, titled sections of labelled fields, earlier passwords' dates.
LOGIN_DETAILS = "struct<fields:array<struct<designation:string,label:string,value:string>>,sections:array<struct<title:string,fields:array<struct<label:string,value:string>>>>,history:array<struct<value:string,at:string>>>"


def category_key(text: Column, keys: list[str]) -> Column:
    """The key a text names: itself (case and outer blanks aside), else its first number or Roman numeral if that is a key; else
    null. A bounded list of keys, in the plan."""
    low = F.lower(F.trim(text))
    known = F.array(*[F.lit(k) for k in keys])
    token = F.regexp_extract(text, r"(?<![\p{L}\p{N}])([0-9]+|[IVX]+)(?![\p{L}\p{N}])", 1)
    roman = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    number = F.coalesce(F.element_at(roman, token), F.regexp_replace(F.nullif(token, F.lit("")), "^0+(?=.)", ""))
    return F.coalesce(F.get(F.filter(known, lambda k: F.lower(k) == low), F.lit(0)), F.when(F.array_contains(known, number), number))


def fingerprint(*columns: Column) -> Column:
    """64 bits in hex of columns, nulls told from empty texts: a version for caches, the same in every run and session."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 16)


def resolved_roles(values: DataFrame, roles: DataFrame) -> DataFrame:
    """value_id, vault, role, key, entity_id, created: the entity that an identifier of a role means.

    values: value_id, vault, subject_id, kind, slot, value (normalised). roles: slot, kind, role, namespace (a small dimension,
    broadcast; at most a few hundred rows by its nature). A key is namespace:value@vault; the subject of the first value
    (least value_id) with the key and kind is reused, else an id is made of the key. Combined ahead of the shuffle.
    """
    at = values.filter("value is not null and value <> ''").join(F.broadcast(roles), ["slot", "kind"])
    at = at.withColumn("key", F.concat(F.col("namespace"), F.lit(":"), F.col("value"), F.lit("@"), F.coalesce("vault", F.lit(""))))
    first = at.groupBy("kind", "key").agg(F.min(F.when(F.col("subject_id").isNotNull(), F.struct("value_id", "subject_id"))).alias("f"))
    out = at.join(first, ["kind", "key"])
    made = F.concat(F.lit("new-"), F.substring(F.md5(F.concat_ws("|", "kind", "key")), 1, 16))
    return out.select("value_id", "vault", "role", "key", F.coalesce("f.subject_id", made).alias("entity_id"), F.col("f").isNull().alias("created"))


def typed_assertions(values: DataFrame, slots: DataFrame) -> DataFrame:
    """value_id, subject_id, property, value_type, time_kind, valid_from, confidence, blocked of values whose slot is known.

    slots: slot, kind, property, time_rule (open or timeless); a small dimension, broadcast. Values of another type than their
    property's, unreadable ones and those without subject make no assertion. Open properties hold from the value's day on;
    without a day their validity is unknown. A check flag blocks; confidence above 1 is a percentage.
    """
    v = values.join(F.broadcast(slots), ["slot", "kind"]).filter(F.col("value_type") == F.col("property_type")).filter("value is not null and trim(value) <> '' and subject_id is not null")
    kind = F.when(F.col("time_rule") == "timeless", "timeless").when(F.col("day").isNotNull(), "interval").otherwise("unknown")
    conf = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    return v.select("value_id", "subject_id", "property", "value_type", kind.alias("time_kind"), F.when(kind == "interval", F.col("day")).alias("valid_from"), conf.alias("confidence"), F.coalesce("check_flag", F.lit(False)).alias("blocked"))


def links(values: DataFrame, relations: DataFrame) -> DataFrame:
    """subject_id, object_id, relation, confidence, n: links of entities through their values, by the relation of the subject's
    kind (a small dimension, broadcast), with the least confidence of the values behind them (unknown ones aside)."""
    v = values.filter("subject_id is not null and object_id is not null").join(F.broadcast(relations), "kind")
    return v.groupBy("subject_id", "object_id", "relation").agg(F.min("confidence").alias("confidence"), F.count("*").alias("n"))


def active_merges(log: DataFrame, entities: DataFrame) -> DataFrame:
    """from_id, into_id of merges in force: of an entity the latest event (seq) decides, a reversal ends it. Events between
    entities of different kinds, with themselves, or of deleted or unknown ones are refused and change nothing."""
    e = entities.filter("deleted_at is null").select("entity_id", "kind").dropDuplicates(["entity_id"])
    ok = log.filter("from_id <> into_id").join(e.select(F.col("entity_id").alias("from_id"), F.col("kind").alias("_a")), "from_id").join(e.select(F.col("entity_id").alias("into_id"), F.col("kind").alias("_b")), "into_id").filter("_a = _b")
    last = ok.groupBy("from_id").agg(F.max_by(F.struct("action", "into_id"), "seq").alias("l"))
    return last.filter("l.action = 'merge'").select("from_id", "l.into_id")


def holders(identifiers: DataFrame, canonical: DataFrame) -> DataFrame:
    """namespace, value, entity_id: entities that hold an identifier, each brought to the one it is merged into, once."""
    i = identifiers.filter("entity_id is not null and value is not null").select("namespace", "value", F.col("entity_id").alias("from_id")).distinct()
    return i.join(canonical, "from_id", "left").select("namespace", "value", F.coalesce("into_id", "from_id").alias("entity_id")).distinct()


def replaced(store: DataFrame, read: DataFrame, source: str = "source_id") -> DataFrame:
    """The store after sources were read anew: all former rows of these sources go, the new ones come; a source whose new read is
    in `read` only by a null id row loses its rows and gains none. Rows of a null source are kept."""
    gone = read.select(source).filter(F.col(source).isNotNull()).distinct()
    fresh = read.filter(F.col("fact_id").isNotNull())
    return store.join(gone, source, "left_anti").unionByName(fresh.select(store.columns))


def projection(entities: DataFrame, values: DataFrame, conflicts: DataFrame) -> DataFrame:
    """node, kind, neighbour, relation, status, n: the map of entities, their slots and the sources behind them.

    An entity is linked to each of its slots (status conflict where two values of the slot overlap, check where one is flagged,
    else settled) and to each source that states a value of it (evidence). Slots and sources are counted ahead of the shuffle.
    """
    e = entities.filter("deleted_at is null").select(F.col("entity_id").alias("subject_id"), "kind").dropDuplicates(["subject_id"])
    bad = conflicts.select("value_id").distinct().withColumn("_bad", F.lit(True))
    v = values.filter("subject_id is not null").join(bad, "value_id", "left")
    slots = v.groupBy("subject_id", "slot").agg(F.max(F.coalesce("_bad", F.lit(False))).alias("_bad"), F.max(F.coalesce("check_flag", F.lit(False))).alias("_flag"), F.count("*").alias("n"))
    status = F.when(F.col("_bad"), "conflict").when(F.col("_flag"), "check").otherwise("settled")
    by_slot = slots.select("subject_id", F.col("slot").alias("neighbour"), F.lit("slot").alias("relation"), status.alias("status"), "n")
    by_source = v.filter("source_id is not null").groupBy("subject_id", F.col("source_id").alias("neighbour")).agg(F.count("*").alias("n")).select("subject_id", "neighbour", F.lit("evidence").alias("relation"), F.lit("settled").alias("status"), "n")
    return by_slot.unionByName(by_source).join(e, "subject_id").select(F.col("subject_id").alias("node"), "kind", "neighbour", "relation", "status", "n")


def observations(rows: DataFrame, run: str, keys: list[str], id: str) -> DataFrame:
    """run, keys, first id, repeats: candidate rows of a run, immutable and once each (null-safe keys); what a later delivery
    repeats changes nothing."""
    return rows.groupBy(run, *keys).agg(F.min(id).alias(id), (F.count("*") - 1).alias("repeats"))


def mapped(observed: DataFrame, wishes: DataFrame, id: str) -> DataFrame:
    """id, assertion_id: the assertion an observation is mapped to: the first wish (seq) holds, later ones change nothing."""
    return wishes.join(observed.select(id), id, "left_semi").groupBy(id).agg(F.min_by("assertion_id", "seq").alias("assertion_id"))


def unfiled(sources: DataFrame, parts: DataFrame, filed: DataFrame, families: DataFrame, most: int = 20) -> DataFrame:
    """vault, source_id, family, rank: of each vault the newest sources with text, a family and no folder; the limit is the feature.
    The rank is cut per vault while sorting, so a vault of any size keeps few rows."""
    text = parts.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("source_id").distinct()
    s = sources.select("vault", "source_id", "received_at").filter("vault is not null").dropDuplicates(["source_id"])
    s = s.join(text, "source_id", "left_semi").join(filed.select("source_id"), "source_id", "left_anti").join(families.select("source_id", "family"), "source_id")
    w = Window.partitionBy("vault").orderBy(F.desc("received_at"), "source_id")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("vault", "source_id", "family", F.col("rank").cast("long").alias("rank"))


def steps(inputs: DataFrame, key: list[str], order: str, run: str) -> DataFrame:
    """Inputs with fingerprint and reused: a step's result is kept under the fingerprint of its key, which leaves out the run;
    only the first input (least order) with a fingerprint is computed."""
    f = inputs.withColumn("fingerprint", fingerprint(*[F.col(k) for k in key]))
    first = f.groupBy("fingerprint").agg(F.min(order).alias("_first"))
    return f.join(first, "fingerprint").withColumn("reused", F.col(order) != F.col("_first")).select(run, order, "fingerprint", "reused")


def login_fields(details: DataFrame, id: str, json: str) -> DataFrame:
    """id, ordinal (from 0), part, label, value: details as rows: the user name, then the password's presence, other fields, sections in
    order, history newest first. Unreadable JSON gives no rows; a password itself never comes out."""
    d = details.select(id, F.from_json(F.col(json), LOGIN_DETAILS).alias("d")).filter("d is not null")
    row = lambda part, label, value: F.struct(F.lit(part).alias("part"), label.alias("label"), value.alias("value"))
    none = F.array().cast("array<struct<part:string,label:string,value:string>>")
    fields = F.coalesce(F.col("d.fields"), F.array().cast("array<struct<designation:string,label:string,value:string>>"))
    pick = lambda want: F.filter(fields, lambda f: F.coalesce(f["designation"], F.lit("")) == want)
    user = F.transform(F.slice(pick("username"), 1, 1), lambda f: row("username", F.lit("username"), f["value"]))
    password = F.transform(F.slice(pick("password"), 1, 1), lambda f: row("password", F.lit("password"), F.when(f["value"].isNotNull(), "set")))
    other = F.transform(F.filter(fields, lambda f: ~F.coalesce(f["designation"], F.lit("")).isin("username", "password")), lambda f: row("field", f["label"], f["value"]))
    sections = F.flatten(F.transform(F.coalesce(F.col("d.sections"), F.array().cast("array<struct<title:string,fields:array<struct<label:string,value:string>>>>")), lambda s: F.transform(s["fields"], lambda f: F.struct(F.lit("section").alias("part"), F.concat_ws(" / ", s["title"], f["label"]).alias("label"), f["value"].alias("value")))))
    history = F.transform(F.reverse(F.array_sort(F.transform(F.coalesce(F.col("d.history"), F.array().cast("array<struct<value:string,at:string>>")), lambda h: F.struct(h["at"].alias("at"))))), lambda h: row("history", h["at"], F.lit("set")))
    every = F.concat(*[F.coalesce(x, none) for x in (user, password, other, sections, history)])
    return d.select(id, F.posexplode(every).alias("ordinal", "f")).select(id, F.col("ordinal").cast("long").alias("ordinal"), "f.part", "f.label", "f.value")
