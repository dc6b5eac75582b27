"""The standing views over the tables; each a function of a Tables-like object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions.text import numeric_item
from lodestone.operators.candidates import active, ids


def _of_entry(t, satellite: DataFrame, *columns: str) -> DataFrame:
    rows = t.entry.select(F.col("id").alias("entry_id"), "catalog", "ext_id", "ext_name", F.col("type").alias("entry_type"), F.col("q").alias("entry_q"), "uid")
    return satellite.select("entry_id", *columns).join(rows, "entry_id")


def vw_aliases(t) -> DataFrame:
    return active(_of_entry(t, t.aliases, "language", "label"), t.catalog)


def vw_dates(t) -> DataFrame:
    return active(_of_entry(t, t.person_dates, "born", "died", "year_born", "year_died"), t.catalog)


def vw_aux(t) -> DataFrame:
    return _of_entry(t, t.auxiliary, "aux_p", "aux_name", "in_wikidata")


def vw_location(t) -> DataFrame:
    return _of_entry(t, t.location, "lat", "lon")


def vw_kv_entry(t) -> DataFrame:
    return _of_entry(t, t.kv_entry, "kv_key", "kv_value")


def vw_mnm_relation(t) -> DataFrame:
    return _of_entry(t, t.mnm_relation, "property", "target_entry_id")


def vw_statement_text(t) -> DataFrame:
    return _of_entry(t, t.statement_text.withColumnRenamed("q", "text_q"), "property", "text", "text_q")


def vw_artwork(t) -> DataFrame:
    """Unmatched works that have a creator noted (property 170) or an edge to one."""
    creators = t.mnm_relation.where("property = 170").select(F.col("entry_id").alias("id"))
    return t.entry.where(S.unmatched() & (F.col("type") == "Q838948")).join(creators, "id", "left_semi")


def vw_artist_artwork(t) -> DataFrame:
    """Unmatched artists with a work, and their years."""
    works = t.mnm_relation.where("property = 170").groupBy(F.col("target_entry_id").alias("id")).agg(F.count("*").alias("works"), F.min("entry_id").alias("first_work"))
    years = t.person_dates.select(F.col("entry_id").alias("id"), "year_born", "year_died")
    artists = t.entry.where(S.unmatched() & (F.col("type") == "Q5")).select("id", "catalog", "ext_name")
    return artists.join(works, "id").join(years, "id", "left")


def vw_common_names(t) -> DataFrame:
    from lodestone.operators.candidates import common_names

    return common_names(t.entry, t.catalog).listed()


def vw_object_creator(t) -> DataFrame:
    """Objects with an edge to a matched creator, and the text to search for."""
    makers = t.entry.where(S.full()).select(F.col("id").alias("target_entry_id"), F.col("q").alias("creator_q"), F.col("ext_name").alias("creator"))
    objects = t.entry.where(S.unmatched()).select(F.col("id").alias("entry_id"), "catalog", "ext_name")
    rows = t.mnm_relation.where("property IN (50, 170)").join(makers, "target_entry_id").join(objects, "entry_id")
    return rows.select("entry_id", "catalog", "property", "creator_q", F.concat_ws(" ", "ext_name", "creator").alias("search"))


def vw_object_creator_aux(t) -> DataFrame:
    rows = t.auxiliary.where(F.col("aux_p").isin(50, 170) & F.col("aux_name").rlike("^Q[0-9]+$"))
    return _of_entry(t, rows.withColumn("creator_q", numeric_item(F.col("aux_name"))), "aux_p", "creator_q")


def vw_issues_mismatched_items(t) -> DataFrame:
    """Open mismatches of entries of active catalogs with a primary property."""
    own = t.catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), "wd_prop")
    rows = t.issues.where("status = 'OPEN' AND type = 'MISMATCH'").select(F.col("id").alias("issue_id"), "entry_id", "catalog").join(own, "catalog")
    return rows.join(t.entry.select(F.col("id").alias("entry_id"), "ext_id", "ext_name"), "entry_id")


def vw_issues_duplicate_items(t) -> DataFrame:
    rows = t.issues.where("status = 'OPEN' AND type = 'WD_DUPLICATE'").select(F.col("id").alias("issue_id"), "entry_id", "json")
    return active(rows.join(t.entry.select(F.col("id").alias("entry_id"), "catalog", "ext_id"), "entry_id"), t.catalog)


def vw_issues_time_mismatch(t) -> DataFrame:
    return t.issues.where("status = 'OPEN' AND type = 'MISMATCH_DATES'").select(F.col("id").alias("issue_id"), "entry_id", "catalog", "json")


def vw_p214(t) -> DataFrame:
    """All VIAF-like identifiers: noted ones, and the native ones of catalogs of the property."""
    noted = t.auxiliary.where("aux_p = 214").select("entry_id", F.col("aux_name").alias("value"))
    own = t.catalog.where("wd_prop = 214").select(F.col("id").alias("catalog"))
    native = t.entry.join(own, "catalog", "left_semi").select(F.col("id").alias("entry_id"), F.col("ext_id").alias("value"))
    return noted.unionByName(native)


def vw_related_catalogs(t) -> DataFrame:
    """Pairs of catalogs that an edge joins."""
    of = lambda id_, name: t.entry.select(F.col("id").alias(id_), F.col("catalog").alias(name))
    rows = t.mnm_relation.join(of("entry_id", "catalog"), "entry_id").join(of("target_entry_id", "other"), "target_entry_id")
    return rows.where("catalog <> other").select("catalog", "other").distinct()


def vw_unmatched_creators_with_matched_work(t) -> DataFrame:
    works = t.entry.where(S.full()).select(F.col("id").alias("entry_id"), F.col("q").alias("work_q"))
    creators = t.entry.where(S.unmatched()).select(F.col("id").alias("target_entry_id"), "ext_name")
    rows = t.mnm_relation.where("property IN (50, 170)").join(works, "entry_id").join(creators, "target_entry_id")
    return rows.groupBy(F.col("target_entry_id").alias("entry_id"), "ext_name").agg(ids("work_q").alias("works"))


def vw_wd_matches(t) -> DataFrame:
    return t.wd_matches.groupBy("status").agg(F.count("*").alias("cnt"))


def vw_catalogs_with_possible_dates(t) -> DataFrame:
    """Active catalogs without a flag about dates whose people's descriptions have a 1."""
    people = t.entry.where("type = 'Q5' AND ext_desc LIKE '%1%'").select(F.col("catalog").alias("id")).distinct()
    return t.catalog.where("active = 1 AND has_person_date NOT IN ('yes', 'no')").join(people, "id", "left_semi").select("id", "name")


def vw_catalogs_with_possible_dates_2(t) -> DataFrame:
    """Catalogs without a flag about dates that have people with dates."""
    people = t.entry.where("type = 'Q5'").join(t.person_dates.select(F.col("entry_id").alias("id")), "id", "left_semi").select(F.col("catalog").alias("id")).distinct()
    return t.catalog.where("has_person_date NOT IN ('yes', 'no')").join(people, "id", "left_semi").select("id", "name")


def vw_catalogs_for_quick_compare(t) -> DataFrame:
    keys = t.kv_catalog.where("kv_key = 'has_locations' AND kv_value = 'yes'").select(F.col("catalog_id").alias("id"))
    return t.catalog.where("active = 1").join(keys, "id", "left_semi").select("id", "name")


def vw_catalogs2sandra(t) -> DataFrame:
    return t.catalog.where("active = 1").select("id", "name", "url", F.concat(F.lit("#/catalog/"), F.col("id").cast("string")).alias("link"))


def vw_potential_missing_wd_catalog_matches(t) -> DataFrame:
    """Catalogs without an item of their own that a term names, ' ID' at the end aside."""
    names = t.catalog.select(F.col("id").alias("catalog"), F.lower(F.regexp_replace("name", " *ID$", "")).alias("name"))
    terms = t.kb_terms.select(F.lower(F.regexp_replace("text", " *ID$", "")).alias("name"), "q").distinct()
    return names.join(terms, "name")
