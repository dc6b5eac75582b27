"""Sweeps that bring the tables back in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S


def drop_lists_of_matched(multi_match: DataFrame, entry: DataFrame) -> DataFrame:
    return multi_match.join(entry.where(S.full()).select(F.col("id").alias("entry_id")), "entry_id", "left_anti")


def fix_statuses(wd_matches: DataFrame, entry: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows of inactive catalogs go, missing catalogs are filled in from the entry,
    and those of catalogs without a primary property are N/A."""
    where_ = entry.select(F.col("id").alias("entry_id"), F.col("catalog").alias("own"))
    filled = wd_matches.join(where_, "entry_id", "left").withColumn("catalog", F.when(F.col("catalog") == 0, F.coalesce("own", "catalog")).otherwise(F.col("catalog"))).drop("own")
    off = catalog.where("active <> 1").select(F.col("id").alias("catalog"))
    bare = catalog.where("wd_prop IS NULL OR wd_qual IS NOT NULL").select(F.col("id").alias("catalog")).withColumn("bare", F.lit(True))
    kept = filled.join(off, "catalog", "left_anti").join(bare, "catalog", "left")
    return kept.withColumn("status", F.when(F.col("bare"), "N/A").otherwise(F.col("status"))).select(*wd_matches.columns)


def sweep_issues(issues: DataFrame, entry: DataFrame, catalog: DataFrame) -> DataFrame:
    """Open issues of inactive catalogs are closed as such, date mismatches about a
    first of January as JAN01, and those of entries without an item by a person go."""
    is_open = F.col("status") == "OPEN"
    off = catalog.where("active <> 1").select(F.col("id").alias("catalog")).withColumn("off", F.lit(True))
    none = entry.where("q <= 0 AND uid > 0").select(F.col("id").alias("entry_id")).withColumn("none", F.lit(True))
    rows = issues.join(off, "catalog", "left").join(none, "entry_id", "left").where(~(is_open & F.coalesce("none", F.lit(False))))
    jan = (F.col("type") == "MISMATCH_DATES") & F.col("json").like("%mnm_time%-01-01%")
    status = F.when(is_open & F.col("off"), "INACTIVE_CATALOG").when(is_open & jan, "JAN01").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*issues.columns)


def resolve_duplicates(issues: DataFrame, redirects: DataFrame) -> DataFrame:
    """Open duplicates of two items of which one redirects to the other are done."""
    items = F.from_json("json", "array<string>")
    number = lambda k: F.regexp_extract(F.element_at(items, k), "Q([0-9]+)", 1).try_cast("bigint")
    two = (F.col("status") == "OPEN") & (F.col("type") == "WD_DUPLICATE") & (F.size(items) == 2)
    rows = issues.withColumn("a", F.when(two, number(1))).withColumn("b", F.when(two, number(2)))
    moved = redirects.select("from_q", "to_q")
    to = lambda c: moved.select(F.col("from_q").alias(c), F.col("to_q").alias(f"{c}_to"))
    rows = rows.join(to("a"), "a", "left").join(to("b"), "b", "left")
    same = F.coalesce(F.col("a_to"), F.col("a")) == F.coalesce(F.col("b_to"), F.col("b"))
    return rows.withColumn("status", F.when(two & same, "DONE").otherwise(F.col("status"))).select(*issues.columns)


def drop_country_of_humans(auxiliary: DataFrame, entry: DataFrame) -> DataFrame:
    people = entry.where("type = 'Q5'").select(F.col("id").alias("entry_id")).withColumn("aux_p", F.lit(17).cast("long"))
    return auxiliary.join(people, ["entry_id", "aux_p"], "left_anti")


def drop_empty_edges(relation: DataFrame) -> DataFrame:
    return relation.where("entry_id <> 0 AND target_entry_id <> 0")


def none_to_unmatched(entry: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("q") == -1, F.lit(False))
    return entry.select(*[F.when(gone, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("q", "uid", "ts") else F.col(c) for c in entry.columns])


def catalogs_with_dates(entry: DataFrame, person_dates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Active catalogs that have dates and no flag about it."""
    dated = entry.join(person_dates.select(F.col("entry_id").alias("id")), "id", "left_semi").select(F.col("catalog").alias("id")).distinct()
    return catalog.where("active = 1 AND has_person_date NOT IN ('yes', 'no')").join(dated, "id", "left_semi").select("id")


def missing_jobs(catalogs: DataFrame, jobs: DataFrame, action: str) -> DataFrame:
    """Jobs of an action for catalogs (id) that have none."""
    have = jobs.where(F.col("action") == action).select(F.col("catalog").alias("id"))
    return catalogs.join(have, "id", "left_anti").select(F.lit(action).alias("action"), F.col("id").alias("catalog"), F.lit("TODO").alias("status"))


def decode_names(entry: DataFrame) -> DataFrame:
    from lodestone.functions.text import decode_entities

    odd = F.col("ext_name").like("%&%;%")
    return entry.withColumn("ext_name", F.when(odd, decode_entities(F.col("ext_name"))).otherwise(F.col("ext_name")))


def mark_properties(todo: DataFrame, catalog: DataFrame) -> DataFrame:
    """Properties to do that some catalog has by now."""
    have = catalog.where("wd_prop IS NOT NULL").select(F.col("wd_prop").alias("property_num")).distinct().withColumn("have", F.lit(True))
    return todo.join(have, "property_num", "left").withColumn("status", F.when(F.col("have"), "HAS_CATALOG").otherwise(F.col("status"))).select(*todo.columns)


def propagate_matched(satellite: DataFrame, entry: DataFrame, flag: str) -> DataFrame:
    """The flag of a satellite row says whether its entry is fully matched."""
    full = entry.select(F.col("id").alias("entry_id"), F.coalesce(S.full(), F.lit(False)).cast("int").alias("_full"))
    return satellite.join(full, "entry_id", "left").withColumn(flag, F.coalesce("_full", F.lit(0))).select(*satellite.columns)


def drop_flagged(auxiliary: DataFrame, prop: int, flagged: DataFrame) -> DataFrame:
    """auxiliary without a property's identifiers (value) that a source marks as no one's."""
    gone = flagged.select(F.col("value").alias("aux_name"), F.lit(prop).cast("long").alias("aux_p")).distinct()
    return auxiliary.join(gone, ["aux_p", "aux_name"], "left_anti").select(*auxiliary.columns)


def undifferentiated(pages: DataFrame, marker: str) -> DataFrame:
    """value of the identifiers whose page (value, html) has the marker; a page that
    could not be read flags nothing."""
    return pages.where(F.coalesce(F.contains("html", F.lit(marker)), F.lit(False))).select("value")


def rebuild_negative(overview: DataFrame, recount: DataFrame) -> DataFrame:
    """overview with a recount of the catalogs in which a count fell below zero."""
    counts = [c for c in overview.columns if c != "catalog"]
    wrong = overview.where(" OR ".join(f"{c} < 0" for c in counts)).select("catalog")
    kept = overview.join(wrong, "catalog", "left_anti")
    return kept.unionByName(recount.select(*overview.columns).join(wrong, "catalog", "left_semi"))


def person_date_jobs(catalogs: DataFrame) -> DataFrame:
    """The three jobs of catalogs (id) that turn out to have dates."""
    actions = F.array(*[F.lit(a) for a in ("match_person_dates", "match_on_birthdate", "match_on_deathdate")])
    return catalogs.select(F.explode(actions).alias("action"), F.col("id").alias("catalog"))
