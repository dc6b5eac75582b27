"""Entries of an external scraper's feed, and its edges between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import dates
from lodestone.operators.store import first_of, numbered, set_columns

ROW = "source_id string, label string, original_label string, description string, url string, q string, p31 long, p569 string, p570 string, revision long"


def parse(lines: DataFrame) -> DataFrame:
    """JSON lines (value) of a feed as rows; bad ones are left out."""
    from lodestone.streaming.feeds import parse_lines

    return parse_lines(lines, ROW)


def entries(rows: DataFrame, catalog: int, revision: int = 0) -> DataFrame:
    """Entries of the rows from a revision on, that have an identifier and a label of
    their own or an original one; born and died by their precision. Of several rows
    of an identifier the last revision counts."""
    name = F.coalesce("label", "original_label", F.lit(""))
    good = rows.where((F.coalesce("revision", F.lit(0)) >= revision) & (F.coalesce("source_id", F.lit("")) != "") & (name != ""))
    return first_of(good, ["source_id"], [F.desc_nulls_last("revision"), name]).select(
        F.lit(catalog).cast("long").alias("catalog"),
        F.col("source_id").alias("ext_id"),
        F.coalesce("url", F.lit("")).alias("ext_url"),
        F.substring(name, 1, 127).alias("ext_name"),
        F.coalesce("description", F.lit("")).alias("ext_desc"),
        F.col("q").try_cast("bigint").alias("q"),
        S.entry_type(F.coalesce(F.concat(F.lit("Q"), F.col("p31").cast("string")), F.lit(""))).alias("type"),
        dates.from_wire(F.col("p569")).alias("born"),
        dates.from_wire(F.col("p570")).alias("died"),
    )


def apply(entry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, changed ids) after a feed: of an entry that is there, name, description,
    type and URL are taken over if any of them differs, its item never."""
    cols = ["ext_name", "ext_desc", "type", "ext_url"]
    incoming = new.select("catalog", "ext_id", *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    both = entry.join(incoming, ["catalog", "ext_id"], "left")
    differs = F.coalesce("_hit", F.lit(False)) & F.exists(F.array(*[~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]), lambda x: x)
    marked = both.withColumn("_differs", differs)
    kept = set_columns(marked, F.col("_differs"), **{c: F.col(f"_{c}") for c in cols})
    fresh = new.join(entry.select("catalog", "ext_id"), ["catalog", "ext_id"], "left_anti")
    added = numbered(fresh.select("catalog", "ext_id", *cols, "q"), entry, [F.col("ext_id")])
    return kept.select(*entry.columns).unionByName(added, allowMissingColumns=True), marked.where("_differs").select("id")


def edges(rows: DataFrame, entry: DataFrame, feed_sources: DataFrame, catalog: int) -> DataFrame:
    """entry_id, property, target_entry_id of a feed's relations (e1_source_id, property,
    e2_scraper_id, e2_source_id) whose ends are both entries."""
    of = lambda id_, catalog_, ext_id: entry.select(F.col("id").alias(id_), F.col("catalog").alias(catalog_), F.col("ext_id").alias(ext_id))
    sources = feed_sources.select(F.col("scraper_id").alias("e2_scraper_id"), F.col("catalog_id").alias("catalog2"))
    known = rows.join(sources, "e2_scraper_id").join(of("target_entry_id", "catalog2", "e2_source_id"), ["catalog2", "e2_source_id"])
    own = of("entry_id", "catalog1", "e1_source_id").where(F.col("catalog1") == catalog)
    return known.join(own, "e1_source_id").select("entry_id", "property", "target_entry_id").distinct()
