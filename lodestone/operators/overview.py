"""Counts of a catalog's entries by match state, whole and by change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S


def refresh(entry: DataFrame, multi_match: DataFrame) -> DataFrame:
    """A row for each catalog: total, the five predicate counts, entries with
    several candidates, and the distinct types."""
    counts = entry.groupBy("catalog").agg(
        F.count("*").alias("total"),
        *[F.count_if(p).alias(b) for b, p in S.bucket_predicates().items()],
        F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"),
    )
    several = multi_match.groupBy("catalog").agg(F.count("*").alias("multi_match"))
    return counts.join(several, "catalog", "left").fillna(0, ["multi_match"])


def classified(entry: DataFrame) -> DataFrame:
    """The same by the classifier, which puts each entry in one bucket."""
    return entry.groupBy("catalog").agg(F.count("*").alias("total"), *[F.count_if(S.bucket() == b).alias(b) for b in S.BUCKETS])


def view(entry: DataFrame) -> DataFrame:
    """A full recount in which every bucket asks for the user too."""
    q, uid = F.col("q"), F.col("uid")
    rules = {"noq": q.isNull(), "autoq": q.isNotNull() & (uid == 0), "na": (q == 0) & (uid > 0), "nowd": (q == -1) & (uid > 0), "manual": S.full()}
    return entry.groupBy("catalog").agg(F.count("*").alias("total"), *[F.count_if(p).alias(b) for b, p in rules.items()])


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of the counts between two states of some entries: one sum over -1
    for what was and +1 for what is, so any order of changes adds up."""
    signed = before.select("catalog", S.bucket().alias("bucket"), F.lit(-1).alias("n")).unionByName(
        after.select("catalog", S.bucket().alias("bucket"), F.lit(1).alias("n"))
    )
    return signed.groupBy("catalog").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in S.BUCKETS])


def apply_delta(overview: DataFrame, change: DataFrame) -> DataFrame:
    counts = ["total", *S.BUCKETS]
    both = overview.select("catalog", *counts).unionByName(change.select("catalog", *counts))
    return both.groupBy("catalog").agg(*[F.sum(c).cast("long").alias(c) for c in counts])


def listing(catalog: DataFrame, overview: DataFrame, users: DataFrame) -> DataFrame:
    """Active catalogs with their counts and owners."""
    owners = users.select(F.col("id").alias("owner"), F.col("name").alias("username"))
    counts = overview.withColumnRenamed("catalog", "id")
    return catalog.where("active >= 1").join(counts, "id", "left").join(owners, "owner", "left")
