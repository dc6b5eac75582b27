"""The control plane as functions from tables to tables: jobs, catalogs, users, files,
scripts, groups and notes that pages and jobs read and change.

Each write gives the table after it; rows that come in are tables too, so one call
writes one row or a million. `now` is a 14-digit timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.store import delete, insert_ignore, numbered, set_columns, upsert


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _number(value: int | None) -> Column:
    return F.lit(value).cast("long")


# -- jobs ---------------------------------------------------------------------


def reset_jobs(jobs: DataFrame, status: str, to: str = "TODO") -> DataFrame:
    """Jobs of a status, such as RUNNING after a restart, are to do again."""
    return set_columns(jobs, F.col("status") == status, status=_text(to))


def queue_jobs(jobs: DataFrame, new: DataFrame, now: str, status: str = "TODO") -> DataFrame:
    """new: action, catalog, depends_on, uid. A job that is there takes status,
    dependency and time; whose it is stays."""
    asked = new.select("action", "catalog", F.col("depends_on").alias("_on"), F.col("uid").alias("_uid")).dropDuplicates(["action", "catalog"])
    both = jobs.join(asked.withColumn("_hit", F.lit(True)), ["action", "catalog"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    kept = set_columns(both, hit, status=_text(status), depends_on=F.col("_on"), last_ts=_text(now)).select(*jobs.columns)
    fresh = asked.join(jobs.select("action", "catalog"), ["action", "catalog"], "left_anti")
    fresh = fresh.select("action", "catalog", F.col("_on").alias("depends_on"), F.col("_uid").alias("uid"), _text(status).alias("status"), _text(now).alias("last_ts"), _text("").alias("next_ts"))
    return kept.unionByName(numbered(fresh, jobs, [F.col("action"), F.col("catalog")]), allowMissingColumns=True)


def ensure_periodic(jobs: DataFrame, action: str, every: int, next_ts: str, now: str) -> DataFrame:
    """A job for no catalog (0) that repeats; one that is there stays as it is."""
    row = jobs.sparkSession.range(1).select(
        _text(action).alias("action"), _number(0).alias("catalog"), _text("DONE").alias("status"), _number(every).alias("repeat_after_sec"), _text(now).alias("last_ts"), _text(next_ts).alias("next_ts"), _number(0).alias("uid")
    )
    fresh = row.join(jobs.select("action", "catalog"), ["action", "catalog"], "left_anti")
    return jobs.unionByName(numbered(fresh, jobs, [F.col("action")]), allowMissingColumns=True)


def set_status(jobs: DataFrame, which: Column, status: str, now: str) -> DataFrame:
    """A change of status takes the note away."""
    return set_columns(jobs, which, status=_text(status), last_ts=_text(now), note=_text(None))


def set_note(jobs: DataFrame, which: Column, note: str) -> DataFrame:
    return set_columns(jobs, which, note=F.substring(_text(note), 1, 250))


def set_cursor(jobs: DataFrame, which: Column, cursor: str | None, now: str) -> DataFrame:
    """Where a job goes on, as text; None starts it anew."""
    return set_columns(jobs, which, json=_text(cursor), last_ts=_text(now))


def set_next_ts(jobs: DataFrame, which: Column, next_ts: str) -> DataFrame:
    return set_columns(jobs, which, next_ts=_text(next_ts))


def due_again(jobs: DataFrame, now: str) -> DataFrame:
    """Finished jobs that repeat get the time after their last run from which they are due."""
    last = F.try_to_timestamp(F.col("last_ts"), F.lit("yyyyMMddHHmmss"))
    following = F.date_format(F.timestamp_add("second", F.col("repeat_after_sec"), last), "yyyyMMddHHmmss")
    return set_columns(jobs, (F.col("status") == "DONE") & F.col("repeat_after_sec").isNotNull(), next_ts=following)


def next_of_actions(jobs: DataFrame, catalog: DataFrame, actions: tuple[str, ...], status: str = "TODO") -> DataFrame:
    """Jobs of these actions without a dependency, of catalogs that aren't switched off, oldest first."""
    off = catalog.where("active <> 1").select(F.col("id").alias("catalog"))
    rows = jobs.where((F.col("status") == status) & F.col("depends_on").isNull() & F.col("action").isin(*actions))
    return rows.join(off, "catalog", "left_anti").orderBy("last_ts", "id")


def known_actions(jobs: DataFrame, job_sizes: DataFrame) -> DataFrame:
    return jobs.select("action").union(job_sizes.select("action")).distinct()


def running(jobs: DataFrame, since: str) -> DataFrame:
    """How many jobs run, and how many of them were heard of since."""
    on = F.col("status") == "RUNNING"
    return jobs.agg(F.count_if(on).alias("running"), F.count_if(on & (F.col("last_ts") >= since)).alias("alive"))


def status_histogram(jobs: DataFrame, catalog: int | None = None) -> DataFrame:
    own = jobs if catalog is None else jobs.where(F.col("catalog") == catalog)
    return own.groupBy("status").agg(F.count("*").alias("cnt"))


# -- catalogs -----------------------------------------------------------------


def create_catalogs(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """new: name and any other columns but id. A name that is there stays as it is."""
    fresh = new.dropDuplicates(["name"]).join(catalog.select("name"), "name", "left_anti")
    return catalog.unionByName(numbered(fresh, catalog, [F.col("name")]), allowMissingColumns=True)


def edit_catalog(catalog: DataFrame, id_: int, **values) -> DataFrame:
    """Property and qualifier 0 mean none."""
    columns = {c: F.nullif(_number(v), _number(0)) if c in ("wd_prop", "wd_qual") else F.lit(v) for c, v in values.items()}
    return set_columns(catalog, F.col("id") == id_, **columns)


def set_active(catalog: DataFrame, id_: int, active: bool) -> DataFrame:
    return set_columns(catalog, F.col("id") == id_, active=F.lit(int(active)))


def set_pairs(kv_catalog: DataFrame, new: DataFrame) -> DataFrame:
    """new: catalog_id, kv_key, kv_value."""
    return upsert(kv_catalog, new, ["catalog_id", "kv_key"])


def delete_pairs(kv_catalog: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(kv_catalog, gone, ["catalog_id", "kv_key"])


def use_automatchers(kv_catalog: DataFrame, catalogs: DataFrame, on: bool) -> DataFrame:
    return set_pairs(kv_catalog, catalogs.select(F.col("id").alias("catalog_id"), _text("use_automatchers").alias("kv_key"), _text(str(int(on))).alias("kv_value")))


def consume_pending(kv_catalog: DataFrame, key: str = "first_fill") -> tuple[DataFrame, DataFrame]:
    """(kv_catalog, catalog_id of the pairs that were pending and now are done)."""
    pending = (F.col("kv_key") == key) & (F.col("kv_value") == "pending")
    return set_columns(kv_catalog, pending, kv_value=_text("done")), kv_catalog.where(pending).select("catalog_id")


def has_person_date(catalog: DataFrame, catalogs: DataFrame, value: str = "yes") -> DataFrame:
    """catalogs: id."""
    hit = catalogs.select("id").distinct().withColumn("_hit", F.lit(True))
    return set_columns(catalog.join(hit, "id", "left"), F.coalesce("_hit", F.lit(False)), has_person_date=_text(value)).select(*catalog.columns)


def rewrite_urls(entry: DataFrame, catalog: int, prefix: str, suffix: str = "") -> DataFrame:
    return set_columns(entry, F.col("catalog") == catalog, ext_url=F.concat(F.lit(prefix), "ext_id", F.lit(suffix)))


def newest_catalogs(catalog: DataFrame, kv_catalog: DataFrame, n: int = 50) -> DataFrame:
    """Active catalogs by the time at which they were made, the newest first."""
    made = kv_catalog.where("kv_key = 'created_at'").select(F.col("catalog_id").alias("id"), F.col("kv_value").alias("created_at"))
    return catalog.where("active = 1").join(made, "id").select("id", "name", "descr", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def latest_catalogs(catalog: DataFrame, overview: DataFrame, n: int = 20) -> DataFrame:
    counts = overview.select(F.col("catalog").alias("id"), "total", "manual")
    rows = catalog.where("active = 1").join(counts, "id", "left").fillna(0, ["total", "manual"])
    return rows.select("id", "name", "descr", "type", "total", "manual").orderBy(F.desc("id")).limit(n)


def with_locations(catalog: DataFrame, kv_catalog: DataFrame, overview: DataFrame) -> DataFrame:
    flagged = kv_catalog.where("kv_key = 'has_locations' AND kv_value = 'yes'").select(F.col("catalog_id").alias("id"))
    counts = overview.select(F.col("catalog").alias("id"), "total", "manual")
    rows = catalog.where("active = 1").join(flagged, "id", "left_semi").join(counts, "id", "left").fillna(0, ["total", "manual"])
    return rows.select("id", "name", "total", "manual").orderBy("name")


def types_of_catalogs(catalog: DataFrame) -> DataFrame:
    return catalog.where("active = 1 AND type <> ''").groupBy("type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "type")


def other_user_of_property(catalog: DataFrame, prop: int, but: int = 0) -> DataFrame:
    """The first other active catalog with the property as its own."""
    rows = catalog.where((F.col("active") == 1) & (F.col("wd_prop") == prop) & F.col("wd_qual").isNull() & (F.col("id") != but))
    return rows.select("id", "name").orderBy("id").limit(1)


def catalogs_by_group(catalog: DataFrame, property_cache: DataFrame, group: str) -> DataFrame:
    """Active catalogs of a group by its slug: all, ig_no_property, ig_<label> and
    country_<label> by the property's classes or country, else a type."""
    active = catalog.where("active = 1")
    if group == "all":
        return active
    if group == "ig_no_property":
        return active.where("coalesce(wd_prop, 0) = 0")
    for prefix, kind in (("ig_", 31), ("country_", 17)):
        if group.startswith(prefix):
            label = F.lower(F.replace("label", F.lit(" "), F.lit("_")))
            props = property_cache.where((F.col("prop_group") == kind) & (label == group.removeprefix(prefix).lower())).select(F.col("property").alias("wd_prop"))
            return active.where("wd_qual IS NULL").join(props.distinct(), "wd_prop", "left_semi")
    return active.where(F.col("type") == group)


def property_group_members(catalog: DataFrame, property_cache: DataFrame) -> DataFrame:
    """slug, catalog: the groups to which active catalogs belong by their property."""
    label = F.regexp_replace(F.lower(F.trim("label")), "\\s+", "_")
    slug = F.concat(F.when(F.col("prop_group") == 31, "ig_").otherwise("country_"), label)
    own = catalog.where("active = 1").select(F.col("id").alias("catalog"), F.nullif("wd_prop", _number(0)).alias("property"))
    grouped = own.join(property_cache.select("property", slug.alias("slug")).distinct(), "property").select("slug", "catalog")
    return grouped.unionByName(own.where("property IS NULL").select(F.lit("ig_no_property").alias("slug"), "catalog")).distinct()


# -- users, files, values -----------------------------------------------------


def ensure_users(users: DataFrame, names: DataFrame) -> DataFrame:
    """names: name. Users that aren't there are added."""
    fresh = names.select("name").distinct().join(users.select("name"), "name", "left_anti").withColumn("is_catalog_admin", F.lit(0))
    return users.unionByName(numbered(fresh, users, [F.col("name")]))


def of_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of many keys at once."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def save_file(import_file: DataFrame, new: DataFrame) -> DataFrame:
    """new: uuid, uid, ts, type; what is there stays."""
    return insert_ignore(import_file, new, ["uuid"])


def set_values(kv: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(kv, new, ["kv_key"])


def new_version(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new becomes the current version for its keys; the versions before stay, retired."""
    hit = new.select(key).distinct().withColumn("_hit", F.lit(True))
    retired = set_columns(table.join(hit, key, "left"), F.coalesce("_hit", F.lit(False)), is_current=F.lit(0)).select(*table.columns)
    return retired.unionByName(numbered(new, table, [F.col(key)]).withColumn("is_current", F.lit(1)), allowMissingColumns=True)


# -- scrapers and feeds -------------------------------------------------------


def save_scrapers(scrapers: DataFrame, new: DataFrame) -> DataFrame:
    """new: catalog, json, owner. One that is there keeps its state."""
    named = new.select("catalog", F.col("json").alias("_json"), F.col("owner").alias("_owner")).dropDuplicates(["catalog"])
    both = scrapers.join(named.withColumn("_hit", F.lit(True)), "catalog", "left")
    kept = set_columns(both, F.coalesce("_hit", F.lit(False)), json=F.col("_json"), owner=F.col("_owner")).select(*scrapers.columns)
    fresh = named.join(scrapers.select("catalog"), "catalog", "left_anti").select("catalog", F.col("_json").alias("json"), F.col("_owner").alias("owner"), _text("").alias("status"), _text("").alias("last_update"))
    return kept.unionByName(fresh)


def scraper_state(scrapers: DataFrame, which: Column, status: str, now: str) -> DataFrame:
    return set_columns(scrapers, which, status=_text(status), last_update=_text(now))


def delete_scrapers(scrapers: DataFrame, jobs: DataFrame, catalogs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scrapers, jobs) without those of the catalogs (catalog)."""
    return delete(scrapers, catalogs, ["catalog"]), delete(jobs, catalogs.select("catalog", F.lit("autoscrape").alias("action")), ["catalog", "action"])


def synced(feed_sources: DataFrame, scrapers: DataFrame, now: str) -> DataFrame:
    """scrapers: scraper_id."""
    hit = scrapers.select("scraper_id").distinct().withColumn("_hit", F.lit(True))
    return set_columns(feed_sources.join(hit, "scraper_id", "left"), F.coalesce("_hit", F.lit(False)), last_sync=_text(now)).select(*feed_sources.columns)


# -- properties, groups, scripts, reports -------------------------------------


def add_properties(props_todo: DataFrame, properties: DataFrame) -> DataFrame:
    """properties: property_num, property_name; a name that is missing is the number."""
    name = F.coalesce("property_name", F.concat(F.lit("P"), F.col("property_num").cast("string")))
    fresh = properties.select("property_num", name.alias("property_name")).dropDuplicates(["property_num"]).withColumns(
        {"default_type": _text(""), "status": _text("NO_CATALOG"), "note": _text(""), "uid": _number(0), "items_using": _number(None)}
    )
    return insert_ignore(props_todo, fresh, ["property_num"])


def count_users(props_todo: DataFrame, claims: DataFrame) -> DataFrame:
    """How many items use each property whose number isn't known yet."""
    used = claims.groupBy(F.col("property").alias("property_num")).agg(F.count_distinct("q").alias("_n"))
    return props_todo.join(used, "property_num", "left").withColumn("items_using", F.coalesce("items_using", "_n")).select(*props_todo.columns)


def set_property_status(props_todo: DataFrame, prop: int, status: str, note: str, uid: int) -> DataFrame:
    return set_columns(props_todo, F.col("property_num") == prop, status=_text(status), note=_text(note), uid=_number(uid))


class TooFewRows(ValueError):
    """A source answers with less than it always has: it is out of order."""


def replace_table(new: DataFrame, least: int) -> DataFrame:
    """new in place of a table, unless it has fewer rows than it must have."""
    n = new.count()
    if n < least:
        raise TooFewRows(f"{n} rows, at least {least} were expected")
    return new


def cached_properties(property_cache: DataFrame, catalog: DataFrame) -> DataFrame:
    """prop_group, property, item, label for the properties of primary catalogs."""
    own = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("wd_prop").alias("property")).distinct()
    return property_cache.join(own, "property", "left_semi").select("prop_group", "property", "item", "label").distinct()


def current_groups(top_groups: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("id").alias("uid"), F.col("name").alias("user_name"))
    return top_groups.where("is_current = 1").join(names, "uid").orderBy("name", "id")


def set_group(top_groups: DataFrame, name: str, catalogs: str, uid: int, now: str, based_on: int = 0) -> DataFrame:
    """A group's new version; the one that it is based on is retired."""
    retired = set_columns(top_groups, (F.col("id") == based_on) & F.lit(based_on > 0), is_current=F.lit(0))
    row = top_groups.sparkSession.range(1).select(
        _text(name).alias("name"), _text(catalogs).alias("catalogs"), _number(uid).alias("uid"), _text(now).alias("ts"), F.lit(1).alias("is_current"), _number(based_on).alias("based_on")
    )
    return retired.unionByName(numbered(row, top_groups, [F.col("name")]))


def retire_empty_groups(top_groups: DataFrame, which: Column) -> DataFrame:
    return set_columns(top_groups, which & (F.col("catalogs") == ""), is_current=F.lit(0))


def active_script(scripts: DataFrame, kind: str, catalog: int) -> DataFrame:
    return scripts.where((F.col("kind") == kind) & (F.col("catalog") == catalog) & (F.col("is_active") == 1) & (F.trim("code") != ""))


def script_examples(scripts: DataFrame, catalog: DataFrame, kind: str = "", search: str = "", n: int = 50, offset: int = 0) -> DataFrame:
    rows = scripts if not kind else scripts.where(F.col("kind") == kind)
    if search:
        rows = rows.where(F.lower("code").contains(search.lower()))
    names = catalog.select(F.col("id").alias("catalog"), F.col("name").alias("catalog_name"))
    return rows.join(names, "catalog", "left").select("id", "kind", "catalog", "catalog_name", "code", (F.col("code") != "").alias("has_code"), "is_active").orderBy("kind", "catalog", "id").offset(offset).limit(n)


def save_scripts(scripts: DataFrame, new: DataFrame) -> DataFrame:
    """new: id, kind, catalog, code, note, is_active; without an id it is a new one, else
    kind and catalog stay."""
    known = new.where("id IS NOT NULL").select("id", *[F.col(c).alias(f"_{c}") for c in ("code", "note", "is_active")], F.lit(True).alias("_hit"))
    both = scripts.join(known, "id", "left")
    kept = set_columns(both, F.coalesce("_hit", F.lit(False)), **{c: F.col(f"_{c}") for c in ("code", "note", "is_active")}).select(*scripts.columns)
    fresh = numbered(new.where("id IS NULL"), scripts, [F.col("kind"), F.col("catalog")])
    return kept.unionByName(fresh, allowMissingColumns=True)


def touch_script(scripts: DataFrame, kind: str, catalog: int, now: str) -> DataFrame:
    return set_columns(scripts, (F.col("kind") == kind) & (F.col("catalog") == catalog), last_run=_text(now))


def open_reports(large_report: DataFrame) -> DataFrame:
    return large_report.where("status <> 'DONE'").groupBy("catalog_id").agg(F.count("*").alias("cnt"))


def report_matrix(large_report: DataFrame, catalog: int) -> DataFrame:
    return large_report.where(F.col("catalog_id") == catalog).groupBy("prop", "status", "type").agg(F.count("*").alias("cnt"))


def report_list(large_report: DataFrame, catalog: int, status: str = "", type_: str = "", user: str = "", prop: int | None = None, n: int = 50, offset: int = 0) -> DataFrame:
    rows = large_report.where(F.col("catalog_id") == catalog)
    for column, value in (("status", status), ("type", type_), ("user_name", user), ("prop", prop)):
        if value not in ("", None):
            rows = rows.where(F.col(column) == value)
    return rows.orderBy("id").offset(offset).limit(n)


def recent_reports(large_report: DataFrame, people_only: bool = False, n: int = 50, offset: int = 0) -> DataFrame:
    rows = large_report.where("user_name <> ''") if people_only else large_report
    return rows.orderBy(F.desc("ts"), "id").offset(offset).limit(n)


def set_report_status(large_report: DataFrame, id_: int, status: str, user: str, now: str) -> DataFrame:
    return set_columns(large_report, F.col("id") == id_, status=_text(status), user_name=_text(user), ts=_text(now))


def queue_references(reference_queue: DataFrame, items: DataFrame) -> DataFrame:
    """items: q; those that are there are to do again."""
    return upsert(reference_queue, items.where("q > 0").select("q").distinct().withColumn("done", F.lit(0)), ["q"])


def pending_references(reference_queue: DataFrame, n: int = 50) -> DataFrame:
    return reference_queue.where("done = 0").select("q").orderBy(F.desc("q")).limit(n)


def references_done(reference_queue: DataFrame, items: DataFrame) -> DataFrame:
    return upsert(reference_queue, items.select("q").distinct().withColumn("done", F.lit(1)), ["q"])
