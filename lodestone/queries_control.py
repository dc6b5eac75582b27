"""Queries of the control plane: jobs, catalogs, users, files, scripts, groups, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import control, overview, store
from lodestone.registry import PRIMARY, query

NOW = "20250101000000"
_OVER = "SELECT catalog, count(*) AS total, count(*) FILTER (q > 0 AND uid > 0) AS manual FROM entry GROUP BY 1"


# -- jobs ---------------------------------------------------------------------


@query("SELECT id, CASE status WHEN 'FAILED' THEN 'TODO' ELSE status END AS status FROM jobs")
def jobs_reset_failed(t):
    return control.reset_jobs(t.jobs, "FAILED").select("id", "status")


@query("SELECT id, CASE status WHEN 'DONE' THEN 'RUNNING' ELSE status END AS status FROM jobs WHERE status <> 'TODO' UNION ALL SELECT id, 'TODO' FROM jobs WHERE status = 'TODO'")
def jobs_reset_running(t):
    """Every finished job as a running one, and back: only the others would change."""
    on = control.reset_jobs(t.jobs, "DONE", "RUNNING")
    return control.reset_jobs(control.reset_jobs(on, "RUNNING", "X"), "X", "RUNNING").select("id", "status")


_ONE_JOB = "SELECT min(id) AS id, action, catalog FROM jobs GROUP BY 2, 3"


@query(f"""WITH j AS ({_ONE_JOB}), n AS (SELECT CASE id % 2 WHEN 0 THEN 'automatch' ELSE 'taxa' END AS action, id AS catalog FROM catalog), f AS (SELECT * FROM n WHERE (action, catalog) NOT IN (SELECT (action, catalog) FROM j))
           SELECT j.action, j.catalog, CASE WHEN n.action IS NOT NULL THEN 'TODO' ELSE 'OLD' END AS status, j.id FROM j LEFT JOIN n ON n.action = j.action AND n.catalog = j.catalog
           UNION ALL SELECT action, catalog, 'TODO', (SELECT max(id) FROM j) + row_number() OVER (ORDER BY action, catalog) FROM f""")
def jobs_queue(t):
    """Jobs for every catalog; those that are there are queued again, with their id."""
    one = t.jobs.groupBy("action", "catalog").agg(F.min("id").alias("id")).withColumns(
        {"status": F.lit("OLD"), "depends_on": F.lit(None).cast("long"), "last_ts": F.lit(""), "next_ts": F.lit(""), "uid": F.lit(0).cast("long")}
    )
    new = t.catalog.select(F.when(F.col("id") % 2 == 0, "automatch").otherwise("taxa").alias("action"), F.col("id").alias("catalog"), F.lit(None).cast("long").alias("depends_on"), F.lit(7).cast("long").alias("uid"))
    return control.queue_jobs(one, new, NOW).select("action", "catalog", "status", "id")


@query("SELECT id, action, catalog, status FROM jobs UNION ALL SELECT (SELECT max(id) FROM jobs) + 1, 'update_issues', 0, 'DONE'")
def jobs_periodic(t):
    """A periodic job is added once."""
    once = control.ensure_periodic(t.jobs, "update_issues", 3600, NOW, NOW)
    return control.ensure_periodic(once, "update_issues", 60, NOW, NOW).select("id", "action", "catalog", "status")


@query(f"SELECT id, CASE WHEN catalog = 3 THEN 'RUNNING' ELSE status END AS status, CASE WHEN catalog = 3 THEN '{NOW}' ELSE last_ts END AS last_ts, CASE WHEN catalog = 3 THEN NULL ELSE note END AS note FROM jobs")
def jobs_set_status(t):
    return control.set_status(t.jobs, F.col("catalog") == 3, "RUNNING", NOW).select("id", "status", "last_ts", "note")


@query("SELECT id, CASE WHEN catalog = 4 THEN 250 ELSE length(note) END AS n FROM jobs")
def jobs_set_note(t):
    return control.set_note(t.jobs, F.col("catalog") == 4, "x" * 400).select("id", F.length("note").cast("long").alias("n"))


@query("SELECT id, CASE catalog WHEN 3 THEN 'row 7' WHEN 4 THEN NULL ELSE json END AS json FROM jobs")
def jobs_cursor(t):
    """A cursor is kept for one catalog's jobs and dropped for another's."""
    kept = control.set_cursor(t.jobs, F.col("catalog") == 3, "row 7", NOW)
    return control.set_cursor(kept, F.col("catalog") == 4, None, NOW).select("id", "json")


@query(f"SELECT id, CASE WHEN catalog = 5 THEN '{NOW}' ELSE next_ts END AS next_ts FROM jobs")
def jobs_set_next_ts(t):
    return control.set_next_ts(t.jobs, F.col("catalog") == 5, NOW).select("id", "next_ts")


@query("SELECT id, CASE WHEN status = 'DONE' AND repeat_after_sec IS NOT NULL THEN strftime(strptime(last_ts, '%Y%m%d%H%M%S') + INTERVAL 1 HOUR, '%Y%m%d%H%M%S') ELSE next_ts END AS next_ts FROM jobs")
def jobs_due_again(t):
    return control.due_again(t.jobs, NOW).select("id", "next_ts")


@query("SELECT id, action FROM jobs WHERE status = 'TODO' AND depends_on IS NULL AND action IN ('automatch', 'aux2wd') AND catalog NOT IN (SELECT id FROM catalog WHERE active <> 1)")
def jobs_next_of_actions(t):
    return control.next_of_actions(t.jobs, t.catalog, ("automatch", "aux2wd")).select("id", "action")


@query("SELECT action FROM jobs UNION SELECT action FROM job_sizes")
def job_actions(t):
    return control.known_actions(t.jobs, t.job_sizes)


@query("SELECT action, size, max_seconds FROM job_sizes WHERE max_seconds IS NOT NULL")
def job_budgets(t):
    """Sizes and time limits of actions."""
    return t.job_sizes.where("max_seconds IS NOT NULL").select("action", "size", "max_seconds")


@query("SELECT count(*) FILTER (status = 'DONE') AS running, count(*) FILTER (status = 'DONE' AND last_ts >= '19950101000000') AS alive FROM jobs")
def jobs_running(t):
    return control.running(control.reset_jobs(t.jobs, "DONE", "RUNNING"), "19950101000000")


@query("SELECT status, count(*) AS cnt FROM jobs WHERE catalog = 3 GROUP BY 1")
def job_histogram(t):
    return control.status_histogram(t.jobs, 3)


@query("SELECT * FROM (SELECT id, action, catalog, json, status, note, uid FROM jobs WHERE id IN (SELECT id FROM jobs ORDER BY id LIMIT 3)) x")
def job_rows(t):
    return control.of_keys(t.jobs, t.jobs.select("id").orderBy("id").limit(3), "id").select("id", "action", "catalog", "json", "status", "note", "uid")


# -- catalogs -----------------------------------------------------------------


@query("SELECT id, name, active FROM catalog UNION ALL SELECT (SELECT max(id) FROM catalog) + row_number() OVER (ORDER BY r_name), r_name, 1 FROM region")
def catalogs_create(t):
    """A catalog for every region, and once more: names that are there stay."""
    new = t.driver("region").select(F.col("r_name").alias("name"), F.lit(1).alias("active"))
    once = control.create_catalogs(t.catalog, new)
    return control.create_catalogs(once, new.unionByName(t.catalog.select("name", "active"))).select("id", "name", "active")


@query("SELECT id, CASE id WHEN 6 THEN 'New' ELSE name END AS name, CASE id WHEN 6 THEN NULL ELSE wd_prop END AS wd_prop, CASE id WHEN 6 THEN 300 ELSE wd_qual END AS wd_qual FROM catalog")
def catalogs_edit(t):
    return control.edit_catalog(t.catalog, 6, name="New", wd_prop=0, wd_qual=300).select("id", "name", "wd_prop", "wd_qual")


@query("SELECT id, CASE id WHEN 6 THEN 0 ELSE active END AS active FROM catalog")
def catalogs_set_active(t):
    return control.set_active(t.catalog, 6, False).select("id", "active")


@query("""SELECT catalog_id, kv_key, kv_value FROM kv_catalog WHERE NOT (kv_key = 'use_automatchers') AND catalog_id <> 3 UNION ALL SELECT id, 'use_automatchers', '0' FROM catalog WHERE id <> 3""")
def catalog_pairs(t):
    """Automatchers off everywhere, and the pairs of one catalog deleted."""
    off = control.use_automatchers(t.kv_catalog, t.catalog, False)
    return control.delete_pairs(off, off.where("catalog_id = 3")).select("catalog_id", "kv_key", "kv_value")


@query("SELECT catalog_id, kv_value = 'yes' AS flipped FROM kv_catalog WHERE kv_key = 'has_locations'")
def catalogs_first_fill(t):
    """A pending mark is taken once."""
    pending = store.set_columns(t.kv_catalog.where("kv_key = 'has_locations'"), F.col("kv_value") == "yes", kv_value=F.lit("pending"))
    after, flipped = control.consume_pending(pending, "has_locations")
    again = control.consume_pending(after, "has_locations")[1]
    return after.join(flipped.join(again, "catalog_id", "left_anti").withColumn("f", F.lit(True)), "catalog_id", "left").select("catalog_id", F.coalesce("f", F.lit(False)).alias("flipped"))


@query("SELECT id, CASE WHEN active = 1 AND has_person_date NOT IN ('yes', 'no') AND id IN (SELECT e.catalog FROM entry e JOIN person_dates d ON d.entry_id = e.id) THEN 'yes' ELSE has_person_date END AS has_person_date FROM catalog")
def catalogs_person_date_flag(t):
    from lodestone.operators.maintenance import catalogs_with_dates

    return control.has_person_date(t.catalog, catalogs_with_dates(t.entry, t.person_dates, t.catalog)).select("id", "has_person_date")


@query("SELECT id FROM catalog WHERE active <> 1")
def catalogs_inactive(t):
    return t.catalog.where("active <> 1").select("id")


@query("SELECT id, CASE WHEN catalog = 3 THEN 'http://new.example/' || ext_id || '/x' ELSE ext_url END AS ext_url FROM entry")
def catalog_rewrite_urls(t):
    return control.rewrite_urls(t.entry, 3, "http://new.example/", "/x").select("id", "ext_url")


@query("SELECT c.id, c.name, c.descr, k.kv_value AS created_at FROM catalog c JOIN kv_catalog k ON k.catalog_id = c.id AND k.kv_key = 'created_at' WHERE c.active = 1 ORDER BY created_at DESC, c.id DESC LIMIT 5")
def catalogs_newest(t):
    return control.newest_catalogs(t.catalog, t.kv_catalog, 5)


@query(f"SELECT c.id, c.name, c.descr, c.type, coalesce(o.total, 0) AS total, coalesce(o.manual, 0) AS manual FROM catalog c LEFT JOIN ({_OVER}) o ON o.catalog = c.id WHERE c.active = 1 ORDER BY c.id DESC LIMIT 7")
def catalogs_latest(t):
    return control.latest_catalogs(t.catalog, overview.view(t.entry), 7)


@query(f"""SELECT c.id, c.name, coalesce(o.total, 0) AS total, coalesce(o.manual, 0) AS manual FROM catalog c LEFT JOIN ({_OVER}) o ON o.catalog = c.id
           WHERE c.active = 1 AND c.id IN (SELECT catalog_id FROM kv_catalog WHERE kv_key = 'has_locations' AND kv_value = 'yes')""")
def catalogs_with_locations(t):
    return control.with_locations(t.catalog, t.kv_catalog, overview.view(t.entry))


@query("SELECT type, count(*) AS cnt FROM catalog WHERE active = 1 AND type <> '' GROUP BY 1")
def catalog_types(t):
    return control.types_of_catalogs(t.catalog)


@query("SELECT id, name FROM catalog WHERE active = 1 AND wd_prop = 213 AND wd_qual IS NULL AND id <> 3 ORDER BY id LIMIT 1")
def property_in_use(t):
    return control.other_user_of_property(t.catalog, 213, 3)


@query("""SELECT DISTINCT c.id, c.name FROM catalog c JOIN property_cache p ON p.property = c.wd_prop AND p.prop_group = 31 AND p.label = 'china' WHERE c.active = 1 AND c.wd_qual IS NULL
          UNION ALL SELECT id, name || '!' FROM catalog WHERE active = 1 AND coalesce(wd_prop, 0) = 0 UNION ALL SELECT id, name || '?' FROM catalog WHERE active = 1 AND type = 'art'""")
def catalogs_of_group(t):
    of = lambda g, mark: control.catalogs_by_group(t.catalog, t.property_cache, g).select("id", F.concat("name", F.lit(mark)).alias("name"))
    return of("ig_china", "").unionByName(of("ig_no_property", "!")).unionByName(of("art", "?"))


@query("""SELECT DISTINCT CASE p.prop_group WHEN 31 THEN 'ig_' ELSE 'country_' END || replace(p.label, ' ', '_') AS slug, c.id AS catalog FROM catalog c JOIN property_cache p ON p.property = c.wd_prop WHERE c.active = 1
          UNION SELECT 'ig_no_property', id FROM catalog WHERE active = 1 AND coalesce(wd_prop, 0) = 0""")
def catalog_group_members(t):
    return control.property_group_members(t.catalog, t.property_cache)


@query("SELECT id FROM entry WHERE catalog <> 4")
def catalog_empty(t):
    """A catalog's entries and all that hangs on them go."""
    gone = t.entry.where("catalog = 4").select(F.col("id").alias("entry_id"))
    return store.cascade({"entry": t.entry, "auxiliary": t.auxiliary, "aliases": t.aliases}, gone)["entry"].select("id")


@query("SELECT d.entry_id FROM person_dates d WHERE d.entry_id NOT IN (SELECT id FROM entry WHERE catalog = 4)")
def catalog_clear_dates(t):
    gone = t.entry.where("catalog = 4").select(F.col("id").alias("entry_id"))
    return store.delete(t.person_dates, gone, ["entry_id"]).select("entry_id")


# -- users, files, values -----------------------------------------------------


@query("SELECT id, name FROM users UNION ALL SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY r_name), r_name FROM region")
def users_ensure(t):
    new = t.driver("region").select(F.col("r_name").alias("name")).unionByName(t.users.select("name"))
    return control.ensure_users(t.users, new).select("id", "name")


@query("SELECT id, name, is_catalog_admin FROM users WHERE id IN (SELECT uid FROM top_groups)")
def users_of_ids(t):
    return control.of_keys(t.users, t.top_groups.select(F.col("uid").alias("id")), "id")


@query("SELECT id, name FROM users WHERE name = 'User 7' UNION ALL SELECT id, name FROM users WHERE id = 8")
def users_lookup(t):
    return t.users.where("name = 'User 7'").unionByName(t.users.where("id = 8")).select("id", "name")


@query("SELECT uuid, type, uid FROM import_file UNION ALL SELECT 'new', 'CSV', 3")
def import_files(t):
    """A file is registered once."""
    new = t.spark.createDataFrame([("new", 3, NOW, "CSV"), ("u-1", 9, NOW, "XXX")], "uuid string, uid long, ts string, type string")
    return control.save_file(t.import_file, new).select("uuid", "type", "uid")


@query("SELECT kv_key, CASE kv_key WHEN 'feed_asia' THEN 'x' ELSE kv_value END AS kv_value FROM kv UNION ALL SELECT 'feed_new', 'y'")
def values_set(t):
    new = t.spark.createDataFrame([("feed_asia", "x"), ("feed_new", "y")], "kv_key string, kv_value string")
    return control.set_values(t.kv, new)


@query("""SELECT id, catalog, json, CASE WHEN catalog IN (1, 2) THEN 0 ELSE is_current END AS is_current FROM update_info UNION ALL SELECT (SELECT max(id) FROM update_info) + 1, 1, 'w1', 1 UNION ALL SELECT (SELECT max(id) FROM update_info) + 2, 2, 'w2', 1""")
def import_settings(t):
    """New settings of two catalogs; the versions before are kept, retired."""
    new = t.spark.createDataFrame([(1, "w1", "", 0), (2, "w2", "", 0)], "catalog long, json string, note string, uid long")
    return control.new_version(t.update_info, new, "catalog").select("id", "catalog", "json", "is_current")


# -- scrapers, feeds, properties, groups, scripts, reports --------------------


@query("SELECT catalog, CASE catalog WHEN 2 THEN 'new 2' ELSE json END AS json, status FROM scrapers UNION ALL SELECT 900, 'new 900', ''")
def scrapers_save(t):
    new = t.spark.createDataFrame([(2, "new 2", 5), (900, "new 900", 5)], "catalog long, json string, owner long")
    return control.save_scrapers(t.scrapers, new).select("catalog", "json", "status")


@query(f"SELECT catalog, CASE status WHEN 'RUNNING' THEN 'OK' ELSE status END AS status, CASE status WHEN 'RUNNING' THEN '{NOW}' ELSE last_update END AS last_update FROM scrapers")
def scrapers_finish(t):
    return control.scraper_state(t.scrapers, F.col("status") == "RUNNING", "OK", NOW).select("catalog", "status", "last_update")


@query("SELECT catalog FROM scrapers WHERE catalog NOT IN (1, 2)")
def scrapers_delete(t):
    gone = t.spark.createDataFrame([(1,), (2,)], "catalog long")
    return control.delete_scrapers(t.scrapers, t.jobs, gone)[0].select("catalog")


@query(f"SELECT scraper_id, catalog_id, CASE WHEN catalog_id < 5 THEN '{NOW}' ELSE last_sync END AS last_sync FROM feed_sources UNION ALL SELECT 1, 77, ''")
def feeds_synced(t):
    """A feed is added and others are marked as read."""
    more = store.insert_ignore(t.feed_sources, t.spark.createDataFrame([(1, 77, ""), (3, 78, "")], "scraper_id long, catalog_id long, last_sync string"), ["scraper_id"])
    return control.synced(more, t.feed_sources.where("catalog_id < 5"), NOW)


@query("""SELECT property_num, property_name, status FROM props_todo UNION ALL SELECT property, 'P' || CAST(property AS VARCHAR), 'NO_CATALOG' FROM (SELECT DISTINCT property FROM kb_claims) p WHERE property NOT IN (SELECT property_num FROM props_todo)""")
def properties_add(t):
    new = t.kb_claims.select(F.col("property").alias("property_num"), F.lit(None).cast("string").alias("property_name")).distinct()
    return control.add_properties(t.props_todo, new).select("property_num", "property_name", "status")


@query("SELECT p.property_num, coalesce(p.items_using, c.n) AS items_using FROM props_todo p LEFT JOIN (SELECT property, count(DISTINCT q) AS n FROM kb_claims GROUP BY 1) c ON c.property = p.property_num")
def properties_usage(t):
    return control.count_users(t.props_todo, t.kb_claims).select("property_num", "items_using")


@query("SELECT property_num, CASE WHEN property_num IN (SELECT wd_prop FROM catalog WHERE wd_prop IS NOT NULL) THEN 'HAS_CATALOG' ELSE status END AS status FROM props_todo")
def properties_with_catalog(t):
    from lodestone.operators.maintenance import mark_properties

    return mark_properties(t.props_todo, t.catalog).select("property_num", "status")


@query("SELECT property_num, CASE property_num WHEN 205 THEN 'DONE' ELSE status END AS status, CASE property_num WHEN 205 THEN 'seen' ELSE note END AS note, CASE property_num WHEN 205 THEN 8 ELSE uid END AS uid FROM props_todo")
def properties_status(t):
    return control.set_property_status(t.props_todo, 205, "DONE", "seen", 8).select("property_num", "status", "note", "uid")


@query("SELECT property_num, property_name, status, items_using FROM props_todo WHERE status = 'NO_CATALOG'")
def missing_properties(t):
    return t.props_todo.where("status = 'NO_CATALOG'").select("property_num", "property_name", "status", "items_using")


@query(f"SELECT DISTINCT prop_group, property, item, label FROM property_cache WHERE property IN (SELECT wd_prop FROM catalog WHERE {PRIMARY})")
def property_cache_view(t):
    """The cache is replaced by what a source answers, if that is enough, and read."""
    return control.cached_properties(control.replace_table(t.property_cache, 20), t.catalog)


@query("SELECT g.id, g.name, g.catalogs, u.name AS user_name FROM top_groups g JOIN users u ON u.id = g.uid WHERE g.is_current = 1")
def groups_current(t):
    return control.current_groups(t.top_groups, t.users).select("id", "name", "catalogs", "user_name")


@query("SELECT id, name, CASE id WHEN 4 THEN 0 ELSE is_current END AS is_current FROM top_groups UNION ALL SELECT (SELECT max(id) FROM top_groups) + 1, 'mine', 1")
def groups_set(t):
    return control.set_group(t.top_groups, "mine", "1,2", 7, NOW, based_on=4).select("id", "name", "is_current")


@query("SELECT id, CASE WHEN catalogs = '' AND id < 20 THEN 0 ELSE is_current END AS is_current FROM top_groups")
def groups_retire_empty(t):
    return control.retire_empty_groups(t.top_groups, F.col("id") < 20).select("id", "is_current")


@query("SELECT id, code FROM scripts WHERE kind = 'AUX_FROM_DESC' AND catalog = 0 AND is_active = 1 AND code <> ''")
def script_active(t):
    return control.active_script(t.scripts, "AUX_FROM_DESC", 0).select("id", "code")


@query("SELECT id, kind FROM scripts WHERE catalog = 2 UNION ALL SELECT -1, kind FROM (SELECT DISTINCT kind FROM scripts) k")
def scripts_of_catalog(t):
    """A catalog's scripts, and all kinds."""
    kinds = t.scripts.select(F.lit(-1).cast("long").alias("id"), "kind").distinct()
    return t.scripts.where("catalog = 2").select("id", "kind").unionByName(kinds)


@query("""SELECT s.id, s.kind, s.catalog, c.name AS catalog_name, s.code, s.code <> '' AS has_code, s.is_active FROM scripts s LEFT JOIN catalog c ON c.id = s.catalog WHERE lower(s.code) LIKE '%code of%' ORDER BY s.kind, s.catalog, s.id LIMIT 5 OFFSET 1""")
def script_examples(t):
    return control.script_examples(t.scripts, t.catalog, search="CODE of", n=5, offset=1)


@query("SELECT id, kind, CASE id WHEN 3 THEN 'changed' ELSE code END AS code FROM scripts UNION ALL SELECT (SELECT max(id) FROM scripts) + 1, 'PERSON_DATE', 'new'")
def scripts_save(t):
    new = t.spark.createDataFrame([(3, "X", 9, "changed", "", 1), (None, "PERSON_DATE", 9, "new", "", 1)], "id long, kind string, catalog long, code string, note string, is_active int")
    return control.save_scripts(t.scripts, new).select("id", "kind", "code")


@query(f"SELECT id, CASE WHEN kind = 'PERSON_DATE' AND catalog = 2 THEN '{NOW}' ELSE last_run END AS last_run FROM scripts")
def script_touch(t):
    return control.touch_script(t.scripts, "PERSON_DATE", 2, NOW).select("id", "last_run")


@query("SELECT catalog_id, count(*) AS cnt FROM large_report WHERE status <> 'DONE' GROUP BY 1")
def large_open(t):
    return control.open_reports(t.large_report)


@query("SELECT prop, status, type, count(*) AS cnt FROM large_report WHERE catalog_id = 2 GROUP BY 1, 2, 3")
def large_matrix(t):
    return control.report_matrix(t.large_report, 2)


@query("SELECT id, ts FROM large_report WHERE catalog_id = 2 AND status = 'OPEN' AND type = 'MISMATCH' AND user_name = 'User 3' AND prop = 204 ORDER BY id LIMIT 50 OFFSET 2")
def large_list(t):
    return control.report_list(t.large_report, 2, "OPEN", "MISMATCH", "User 3", 204, offset=2).select("id", "ts")


@query("SELECT id, ts FROM large_report WHERE user_name <> '' ORDER BY ts DESC, id LIMIT 20")
def large_recent(t):
    return control.recent_reports(t.large_report, True, 20).select("id", "ts")


@query("SELECT id, CASE WHEN id = 11 THEN 'DONE' ELSE status END AS status, CASE WHEN id = 11 THEN 'me' ELSE user_name END AS user_name FROM large_report")
def large_set_status(t):
    return control.set_report_status(t.large_report, 11, "DONE", "me", NOW).select("id", "status", "user_name")


@query("SELECT q FROM (SELECT q FROM reference_queue WHERE done = 0 UNION SELECT 3 UNION SELECT 99) x WHERE q <> 4 ORDER BY q DESC LIMIT 8")
def references_pending(t):
    """Items are queued, done, and queued again."""
    item = lambda *qs: t.spark.createDataFrame([(q,) for q in qs], "q long")
    queue = control.references_done(control.queue_references(t.reference_queue, item(3, 99, -1)), item(4))
    return control.pending_references(queue, 8)
