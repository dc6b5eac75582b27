"""Nested entries as JSON: reading, flattening, and importing into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.operators.store import first_of
from lodestone.schema import META_ENTRY


def read(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """JSON lines, or one array; a bad record stops the import."""
    return spark.read.schema(META_ENTRY).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def flatten(meta: DataFrame) -> dict[str, DataFrame]:
    """The satellite tables of nested entries, keyed by catalog and external id."""
    base = meta.withColumns({"catalog": F.col("entry.catalog"), "ext_id": F.col("entry.ext_id")})
    key = ["catalog", "ext_id"]
    each = lambda c, *cols: base.select(*key, F.explode(c).alias("x")).select(*key, *[F.col(f"x.{n}").alias(a) for n, a in cols])
    return {
        "entry": base.select(
            *key, "entry.ext_url", F.substring("entry.ext_name", 1, 127).alias("ext_name"), F.substring("entry.ext_desc", 1, 254).alias("ext_desc"),
            "entry.q", F.col("entry.user").alias("uid"), F.col("entry.timestamp").alias("ts"), S.entry_type(F.col("entry.type")).alias("type"),
        ),
        "auxiliary": each("auxiliary", ("prop_numeric", "aux_p"), ("value", "aux_name")),
        "aliases": each("aliases", ("language", "language"), ("value", "label")),
        "descriptions": base.select(*key, F.explode("descriptions").alias("language", "label")),
        "person_dates": base.where("person_dates IS NOT NULL").select(*key, "person_dates.born", "person_dates.died"),
        "location": base.where("coordinate IS NOT NULL").select(*key, "coordinate.lat", "coordinate.lon"),
        "kv_entry": each("kv_entries", ("key", "kv_key"), ("value", "kv_value")),
    }


def import_entries(entry: DataFrame, new: DataFrame, mode: str = "add_replace") -> DataFrame:
    """entry after an import of `new` (catalog, ext_id, ext_url, ext_name, ext_desc,
    q, uid, ts, type), keyed by catalog and external id regardless of case.

    add adds what is missing; add_replace also replaces what is there;
    add_replace_delete also takes away what a catalog of the import no longer has.
    Entries matched by a user other than the automatic one keep their match and
    are never taken away.
    """
    if mode not in ("add", "add_replace", "add_replace_delete"):
        raise ValueError(mode)
    key = lambda df: df.withColumn("key", S.name_key(F.col("ext_id")))
    fresh = first_of(key(new), ["catalog", "key"], [F.col("ext_id")])
    old = key(entry)
    cols = ["ext_url", "ext_name", "ext_desc", "q", "uid", "ts", "type"]
    incoming = fresh.select("catalog", "key", F.lit(True).alias("hit"), *[F.col(c).alias(f"new_{c}") for c in cols])
    both = old.join(incoming, ["catalog", "key"], "left")
    guarded = F.coalesce(F.col("uid") > 0, F.lit(False))
    if mode != "add":
        hit = F.coalesce("hit", F.lit(False))
        for c in cols:
            keep = ~hit | guarded if c in ("q", "uid", "ts") else ~hit
            both = both.withColumn(f"out_{c}", F.when(keep, F.col(c)).otherwise(F.col(f"new_{c}")))
        if mode == "add_replace_delete":
            touched = fresh.select("catalog").distinct().withColumn("touched", F.lit(True))
            both = both.join(touched, "catalog", "left").where(F.col("touched").isNull() | F.col("hit") | guarded)
        both = both.drop(*cols).withColumnsRenamed({f"out_{c}": c for c in cols})
    added = fresh.join(old.select("catalog", "key"), ["catalog", "key"], "left_anti").withColumn("id", F.lit(None).cast("long"))
    return both.select(*entry.columns).unionByName(added.select(*entry.columns))


def merge_fields(entry: DataFrame, new: DataFrame) -> DataFrame:
    """entry with the fields of `new` that aren't empty; an item only where there is none."""
    incoming = new.select("catalog", "ext_id", *[F.col(c).alias(f"new_{c}") for c in ("ext_name", "ext_desc", "ext_url", "type", "q", "uid")])
    both = entry.join(incoming, ["catalog", "ext_id"], "left")
    for c in ("ext_name", "ext_desc", "ext_url", "type"):
        both = both.withColumn(c, F.when(F.coalesce(F.col(f"new_{c}"), F.lit("")) != "", F.col(f"new_{c}")).otherwise(F.col(c)))
    free = F.col("q").isNull() & F.col("new_q").isNotNull()
    both = both.withColumn("uid", F.when(free, F.col("new_uid")).otherwise(F.col("uid"))).withColumn("q", F.coalesce("q", "new_q"))
    return both.select(*entry.columns)
