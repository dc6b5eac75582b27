"""Repair of references: a URL that stands for an identifier becomes that identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties of a reference, and the suffix that one catalog's URLs carry.
URL, STATED_IN, RETRIEVED = 854, 248, 813
_SUFFIX = "_(Dizionario_Biografico)"


def usable_templates(templates: DataFrame) -> DataFrame:
    """property, template, rx, host of URL templates (property, template) that can tell:
    with a protocol and a place for the identifier, and no resolver of all sources."""
    good = templates.where(F.col("template").rlike("^https?://.") & F.col("template").contains("$1") & ~F.col("template").endswith("doi.org/$1"))
    bare = F.regexp_replace(F.regexp_replace("template", "^https?://", ""), "/$", "")
    escaped = F.regexp_replace(bare, "([.?+*()\\[\\]{}^|\\\\-])", "\\\\$1")
    rx = F.concat(F.lit("^https?://"), F.replace(escaped, F.lit("$1"), F.lit("(.+)")), F.lit("/?$"))
    return good.select("property", "template", rx.alias("rx"), _host(F.col("template")).alias("host"))


def _host(url: Column) -> Column:
    """Lower-case host, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^https?://([^/?#]+)", 1)), "^www\\.", "")


def clean_id(raw: Column) -> Column:
    """A captured identifier: decoded, without what follows &, and slashes at the end."""
    decoded = F.coalesce(F.try_url_decode(raw), raw)
    plain = F.regexp_replace(F.substring_index(decoded, "&", 1), "/+$", "")
    return F.trim(F.when(F.endswith(plain, F.lit(_SUFFIX)), F.substr(plain, F.lit(1), F.length(plain) - len(_SUFFIX))).otherwise(plain))


def identified(urls: DataFrame, templates: DataFrame) -> DataFrame:
    """url, property, value for urls (url) that stand for exactly one identifier of one
    property. Templates are found by host; those whose host holds the identifier
    are few and are tried on every URL."""
    known = usable_templates(templates)
    asked = urls.select("url").distinct().withColumn("host", _host(F.col("url")))
    fixed = asked.join(known.where("NOT contains(host, '$1')"), "host")
    loose = asked.drop("host").join(known.where("contains(host, '$1')").drop("host"), F.rlike(F.col("url"), F.col("rx")))
    hits = fixed.select("url", "property", "rx").unionByName(loose.select("url", "property", "rx")).where(F.rlike(F.col("url"), F.col("rx")))
    found = hits.select("url", "property", clean_id(F.get(F.regexp_extract_all(F.col("url"), F.col("rx"), 1), F.lit(0))).alias("value")).where("value <> ''")
    spread = found.groupBy("url").agg(F.min("property").alias("property"), F.max("property").alias("_p"), F.min("value").alias("value"), F.max("value").alias("_v"))
    return spread.where("property = _p AND value = _v").drop("_p", "_v")


def repairs(references: DataFrame, templates: DataFrame, stated_in: DataFrame) -> DataFrame:
    """statement_id, hash, action, stated_in, property, value of the edits to make.

    references: statement_id, main_property, main_external (whether the statement is
    an external identifier), hash, snaks array<struct<property,value>>. A group that
    only repeats the statement's own identifier, source and date aside, is removed.
    One that is a single URL which stands for one identifier is replaced by it, with
    the source (stated_in: property, q) where that is known, unless it would repeat
    the statement's own. Everything else stays."""
    props = F.transform("snaks", lambda s: s["property"])
    rest = F.array_distinct(F.filter(props, lambda p: ~p.isin(STATED_IN, RETRIEVED)))
    own = F.col("main_external") & (rest == F.array("main_property"))
    marked = references.withColumn("own", F.coalesce(own, F.lit(False)))
    none = F.lit(None).cast("long")
    gone = marked.where("own").select("statement_id", "hash", F.lit("remove").alias("action"), none.alias("stated_in"), none.alias("property"), F.lit(None).cast("string").alias("value"))
    single = marked.where(~F.col("own") & (F.size("snaks") == 1) & (F.col("snaks")[0]["property"] == URL)).withColumn("url", F.col("snaks")[0]["value"])
    found = single.join(identified(single, templates), "url").where("NOT (main_external AND property = main_property)")
    better = found.join(stated_in.select("property", F.col("q").alias("stated_in")), "property", "left")
    return gone.unionByName(better.select("statement_id", "hash", F.lit("replace").alias("action"), "stated_in", "property", "value"))


def edit_summaries(edits: DataFrame, entry: DataFrame, catalog: DataFrame, statement_items: DataFrame) -> DataFrame:
    """edits with entry_id, the entry behind an identifier on the item, or else catalog,
    the only catalog of the property; statement_items: statement_id, q."""
    from lodestone.operators.report import reference_entry, unique_catalog_of_property

    behind = reference_entry(entry, catalog).select("q", F.col("wd_prop").alias("property"), F.col("ext_id").alias("value"), "entry_id")
    only = unique_catalog_of_property(catalog).withColumnRenamed("wd_prop", "property")
    rows = edits.join(statement_items, "statement_id").join(behind, ["q", "property", "value"], "left").join(only, "property", "left")
    return rows.withColumn("catalog", F.when(F.col("entry_id").isNull(), F.col("catalog")))
