"""Change feeds and running counts as Structured Streaming jobs.

Each job is a function of a batch of changes and static tables; foreachBatch runs
it for every micro-batch, and a batch's number makes a repeated write harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import semantics as S
from lodestone.operators.matchers import one_item
from lodestone.operators.store import upsert
from lodestone.operators.sync import unlink


def changes_to_matches(changes: DataFrame, claims: DataFrame, entry: DataFrame, catalog: DataFrame) -> DataFrame:
    """changes: item, property. Entries of catalogs of a changed property whose
    identifier is claimed by exactly one item: entry_id, q."""
    own = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), F.col("wd_prop").alias("property"))
    changed = claims.join(changes.select(F.col("item").alias("q"), "property").distinct(), ["q", "property"], "left_semi")
    values = claims.join(changed.select("property", "value").distinct(), ["property", "value"], "left_semi")
    single = one_item(values, "property", "value").join(own, "property").select("catalog", F.col("value").alias("ext_id"), F.col("q").alias("item"))
    open_ = entry.where(S.not_full()).select(F.col("id").alias("entry_id"), "catalog", "ext_id")
    return open_.join(single, ["catalog", "ext_id"]).select("entry_id", F.col("item").alias("q"))


def redirects_of(changes: DataFrame) -> DataFrame:
    return changes.where("from_q <> to_q AND from_q > 0 AND to_q > 0").select("from_q", "to_q").distinct()


class BadFeed(ValueError):
    """A feed has lines and none can be read: its source is out of order."""


def parse_lines(lines: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines (value); blank and bad ones are left out. If there are lines and all
    are bad, BadFeed is raised, or else a cursor would pass over the outage; a stream
    can't be counted and needs strict=False."""
    found = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").select(found.alias("x"))
    good = rows.where("x IS NOT NULL AND x._bad IS NULL")
    if strict and good.isEmpty() and not rows.isEmpty():
        raise BadFeed("no line of the feed is readable")
    return good.select("x.*").drop("_bad")


def since(changes: DataFrame, kv: DataFrame, stream: str, start: str) -> DataFrame:
    """changes (ts) from the stream's mark on, which is itself read again: several
    changes may share it. kv: kv_key, kv_value; start where there is no mark."""
    mark = kv.where(F.col("kv_key") == stream).agg(F.max("kv_value").alias("mark"))  # one row
    return changes.join(F.broadcast(mark), F.col("ts") >= F.coalesce("mark", F.lit(start))).drop("mark")


def advanced(kv: DataFrame, changes: DataFrame, stream: str) -> DataFrame:
    """kv with the mark at the last change; as it was without changes."""
    last = changes.agg(F.max("ts").alias("kv_value")).where("kv_value IS NOT NULL").withColumn("kv_key", F.lit(stream))
    return upsert(kv, last.select("kv_key", "kv_value"), ["kv_key"])


def deletions(entry: DataFrame, deleted: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry, catalogs): preliminary and userless matches to deleted items (q) go, if
    the items really are no longer there; the catalogs whose counts that changes."""
    gone = deleted.select("q").distinct().join(items.select("q"), "q", "left_anti")
    touched = entry.where("uid IS NULL OR uid = 0").join(gone, "q", "left_semi").select("catalog").distinct()
    return unlink(entry, gone), touched


def once_each(changes: DataFrame, key: list[str], late: str = "1 hour") -> DataFrame:
    """Changes of a stream without those that came before: a feed read from its mark on
    repeats what it had at the mark. The state is kept for as long as `late`."""
    return changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_batches(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write work(batch) for every micro-batch into its own folder under path. A
    batch that runs again after a failure replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_overview(changes: DataFrame) -> DataFrame:
    """changes: catalog, bucket, n (-1 for what was, +1 for what is), as a stream or
    a table: running counts, for update or complete mode."""
    return changes.groupBy("catalog").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(b) for b in S.BUCKETS])


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; an extension, the tables' own feeds have no windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "event_type", "n"
    )
