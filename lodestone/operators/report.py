"""Questions that the web pages and downloads ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.operators.candidates import active, ids


def type_counts(entry: DataFrame, catalog: int) -> DataFrame:
    return entry.where(F.col("catalog") == catalog).groupBy("type").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "type")


def matches_by_month(entry: DataFrame) -> DataFrame:
    return entry.where("ts IS NOT NULL AND uid <> 0").groupBy("catalog", F.substring("ts", 1, 6).alias("ym")).agg(F.count("*").alias("cnt"))


def matches_by_user(entry: DataFrame, users: DataFrame) -> DataFrame:
    """Matches of each person in a catalog; the automatic user doesn't count."""
    made = entry.where("uid > 0").groupBy("catalog", "uid").agg(F.count("*").alias("cnt"))
    return made.join(users.select(F.col("id").alias("uid"), F.col("name").alias("username")), "uid", "left")


def sample_key(column: str = "id") -> Column:
    """A fixed number in [0, 1) for a row, in place of a stored random one."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / float(1 << 30)


def sample(df: DataFrame, n: int, start: float = 0.0, column: str = "id", key: Column | None = None) -> DataFrame:
    """n rows from a place in the fixed random order on; key is a stored random number."""
    drawn = df.withColumn("sample", sample_key(column) if key is None else key)
    return drawn.where(F.col("sample") >= start).orderBy("sample", column).limit(n).drop("sample")


def top_missing(entry: DataFrame, catalogs: tuple[int, ...], n: int = 500) -> DataFrame:
    """Names that several of the catalogs have unmatched."""
    rows = entry.where(F.col("catalog").isin(*catalogs) & (S.unmatched() | (F.col("uid") == 0)))
    found = rows.groupBy(F.col("ext_name").alias("name")).agg(F.count_distinct("catalog").alias("cnt")).where("cnt > 1")
    return found.orderBy(F.desc("cnt"), "name").limit(n)


def same_names(entry: DataFrame) -> DataFrame:
    """Names of a few entries of which some are matched."""
    found = entry.groupBy(F.col("ext_name").alias("name"), "type").agg(F.count("*").alias("cnt"), F.count("q").alias("matched"))
    return found.where("cnt > 1 AND cnt < 10 AND matched > 0 AND matched < cnt")


def name_counts(entry: DataFrame, catalog: int, type_: str, least: int = 1, most: int = 1000) -> DataFrame:
    """Unmatched entries of a catalog and how many entries anywhere have their name."""
    often = entry.where(S.unmatched()).groupBy("ext_name").agg(F.count("*").alias("cnt")).where(F.col("cnt").between(least + 1, most - 1))
    return entry.where((F.col("catalog") == catalog) & (F.col("type") == type_) & S.unmatched()).join(often, "ext_name").select("id", "ext_name", "cnt")


def recent_changes(entry: DataFrame, log: DataFrame, since: str, catalog: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Matches and log rows together, newest first. Each branch keeps only what
    the whole page can need, so the union stays small."""
    own = entry if catalog is None else entry.where(F.col("catalog") == catalog)
    page = limit + offset
    made = own.where((F.col("ts") >= since) & (F.col("uid") > 0)).select(F.lit("match").alias("event"), F.col("id").alias("entry_id"), "q", "uid", "ts", F.lit(0).cast("long").alias("log_id"))
    names = own.select(F.col("id").alias("entry_id"))
    gone = log.where(F.col("ts") >= since).join(names, "entry_id", "left_semi").select(F.col("action").alias("event"), "entry_id", "q", "uid", "ts", F.col("id").alias("log_id"))
    order = [F.desc("ts"), F.col("entry_id"), F.col("event"), F.col("log_id")]
    both = made.orderBy(*order).limit(page).unionByName(gone.orderBy(*order).limit(page))
    return both.orderBy(*order).offset(offset).limit(limit)


def user_edits(entry: DataFrame, log: DataFrame, user: int, limit: int = 100) -> DataFrame:
    made = entry.where(F.col("uid") == user).select(F.col("id").alias("entry_id"), "q", "ts", F.lit("match").alias("event"))
    gone = log.where(F.col("uid") == user).select("entry_id", "q", "ts", F.col("action").alias("event"))
    return made.unionByName(gone).orderBy(F.desc("ts"), "entry_id", "event", "q").limit(limit)


def log_window(log: DataFrame, entry: DataFrame, first: str, last: str) -> DataFrame:
    rows = log.where(F.col("ts").between(first, last)).select(F.col("id").alias("log_id"), "action", "entry_id", F.col("uid").alias("log_uid"), F.col("ts").alias("log_ts"))
    return rows.join(entry.select(F.col("id").alias("entry_id"), "catalog", "ext_name"), "entry_id")


def statement_groups(statement_text: DataFrame, entry: DataFrame, samples: int = 5) -> DataFrame:
    """Texts of a property that no item was chosen for: how many entries have
    each, and the first few of them."""
    key = ["catalog", "property", "text"]
    rows = statement_text.where("q IS NULL").join(entry.select(F.col("id").alias("entry_id"), "catalog"), "entry_id")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("entry_id", "id"))
    few = rows.select(*key, "entry_id", nth.alias("rn")).where(F.col("rn") <= samples)  # each task keeps that many of a text
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "entry_id"))), lambda x: x["entry_id"].cast("string")), ",")
    return rows.groupBy(*key).agg(F.count_distinct("entry_id").alias("cnt")).join(few.groupBy(*key).agg(first.alias("samples")), key)


def unmatched_targets(relation: DataFrame, entry: DataFrame, prop: int, limit: int = 25) -> DataFrame:
    """Unmatched entries that most edges of a property point to."""
    open_ = entry.where(S.unmatched()).select(F.col("id").alias("target_entry_id"))
    found = relation.where(F.col("property") == prop).join(open_, "target_entry_id").groupBy(F.col("target_entry_id").alias("entry_id"))
    return found.agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "entry_id").limit(limit)


def in_box(location: DataFrame, entry: DataFrame, lat: tuple[float, float], lon: tuple[float, float], limit: int = 5000) -> DataFrame:
    rows = location.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    return rows.join(entry.select(F.col("id").alias("entry_id"), "ext_name"), "entry_id").orderBy("entry_id").limit(limit)


def next_jobs(jobs: DataFrame, catalog: DataFrame, status: str = "TODO", denied: tuple[str, ...] = (), due: str | None = None) -> DataFrame:
    """Jobs that may start: their dependency is done, their catalog active, their
    time has come; the one due first is first."""
    rows = jobs.where((F.col("status") == status) & ~F.col("action").isin(*denied)) if denied else jobs.where(F.col("status") == status)
    if due is not None:
        rows = rows.where((F.col("next_ts") != "") & (F.col("next_ts") <= due))
    done = jobs.where("status = 'DONE'").select(F.col("id").alias("depends_on"))
    free = rows.where("depends_on IS NULL").unionByName(rows.where("depends_on IS NOT NULL").join(done, "depends_on", "left_semi").select(*rows.columns))
    off = catalog.where("active <> 1").select(F.col("id").alias("catalog"))
    return free.join(off, "catalog", "left_anti").orderBy("last_ts", "id")


def job_list(jobs: DataFrame, order: tuple[str, ...] = ("RUNNING", "FAILED", "TODO", "DONE")) -> DataFrame:
    """Jobs by status in this order, then newest first."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("status"))
    return jobs.withColumn("place", place).orderBy("place", F.desc("last_ts"), "id")


def search_catalogs(catalog: DataFrame, overview: DataFrame, q: str, limit: int = 20) -> DataFrame:
    hit = F.lower("name").contains(q.lower()) | F.lower("descr").contains(q.lower())
    total = overview.select(F.col("catalog").alias("id"), "total")
    rows = catalog.where(hit & (F.col("active") == 1)).join(total, "id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return rows.select("id", "name", "total").orderBy(F.desc("total"), "id").limit(limit)


def unique_catalog_of_property(catalog: DataFrame) -> DataFrame:
    found = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").groupBy("wd_prop").agg(F.count("*").alias("n"), F.min("id").alias("catalog"))
    return found.where("n = 1").drop("n")


def catalogs_of_properties(catalog: DataFrame) -> DataFrame:
    return catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").groupBy("wd_prop").agg(ids().alias("catalogs"))


def duplicate_items(entry: DataFrame, catalog: int) -> DataFrame:
    return entry.where((F.col("catalog") == catalog) & S.full()).groupBy("q").agg(F.count("*").alias("cnt")).where("cnt > 1")


def reference_entry(entry: DataFrame, catalog: DataFrame) -> DataFrame:
    """The entry behind a claim (q, wd_prop, ext_id) of a primary catalog."""
    own = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), "wd_prop")
    return entry.where("q > 0").join(own, "catalog").groupBy("q", "wd_prop", "ext_id").agg(F.min("id").alias("entry_id"))


def satellites(entry: DataFrame, aliases: DataFrame, descriptions: DataFrame, auxiliary: DataFrame, person_dates: DataFrame) -> DataFrame:
    """An entry with all that hangs on it, nested; each satellite is grouped by
    entry before it joins, so nothing multiplies."""
    a = aliases.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct("language", F.col("label").alias("value")))).alias("aliases"))
    d = descriptions.groupBy("entry_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("language", "label")))).alias("descriptions"))
    x = auxiliary.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct(F.col("aux_p").alias("prop_numeric"), F.col("aux_name").alias("value")))).alias("auxiliary"))
    p = person_dates.select("entry_id", F.struct("born", "died").alias("person_dates"))
    out = entry.withColumnRenamed("id", "entry_id")
    for part in (a, d, x, p):
        out = out.join(part, "entry_id", "left")
    return out


def missing_pages(entry: DataFrame, sitelinks: DataFrame, site: str) -> DataFrame:
    have = sitelinks.where(F.col("site") == site).select("q").distinct()
    return entry.where(S.full()).join(have, "q", "left_anti").select(F.col("id").alias("entry_id"), "catalog", "q")


def creation_candidates(entry: DataFrame, catalog: DataFrame, least_catalogs: int = 2, least_unset: int = 2) -> DataFrame:
    """Names that enough active catalogs have and enough entries lack an item for."""
    found = active(entry, catalog).where("q IS NULL OR q <> -1").groupBy(S.name_key(F.col("ext_name")).alias("name"))
    counted = found.agg(F.count_distinct("catalog").alias("catalogs"), F.count_if(S.unmatched()).alias("unset"), ids().alias("entry_ids"))
    return counted.where((F.col("catalogs") >= least_catalogs) & (F.col("unset") >= least_unset))


def name_variants(names: DataFrame) -> DataFrame:
    """name, variant: a name of three words also with a hyphen at either gap."""
    words = F.split("name", " ")
    join = lambda a, b: F.concat(words[0], F.lit(a), words[1], F.lit(b), words[2])
    variants = F.when(F.size(words) == 3, F.array("name", join("-", " "), join(" ", "-"))).otherwise(F.array("name"))
    return names.select("name", F.explode(variants).alias("variant"))


def open_issues(issues: DataFrame, type_: str = "", catalogs: tuple[int, ...] = ()) -> DataFrame:
    rows = issues.where("status = 'OPEN'")
    if type_:
        rows = rows.where(F.col("type") == type_)
    return rows.where(F.col("catalog").isin(*catalogs)) if catalogs else rows


def issue_page(issues: DataFrame, n: int, start: float = 0.0, key: Column | None = None, **wanted) -> DataFrame:
    """n open issues from a place in the fixed random order on, their JSON as a variant."""
    return sample(open_issues(issues, **wanted), n, start, key=key).withColumn("payload", F.try_parse_json("json"))


def entries_of_item(entry: DataFrame, catalog: DataFrame, q: int, but: tuple[int, ...] = ()) -> DataFrame:
    rows = active(entry.where(F.col("q") == q), catalog)
    return rows.where(~F.col("catalog").isin(*but)) if but else rows


def random_entry(entry: DataFrame, catalog: DataFrame, mode: str = "", type_: str = "", own: int | None = None, start: float = 0.0, key: Column | None = None) -> DataFrame:
    """One entry of an active catalog to work on: `prematched`, `no_manual` or unmatched."""
    wanted = {"prematched": F.col("uid") == 0, "no_manual": S.not_full()}.get(mode, S.unmatched())
    rows = active(entry, catalog).where(wanted)
    rows = rows.where(F.col("type") == type_) if type_ else rows
    rows = rows.where(F.col("catalog") == own) if own is not None else rows
    late = sample(rows, 1, start, key=key).withColumn("_turn", F.lit(0))
    again = sample(rows, 1, 0.0, key=key).withColumn("_turn", F.lit(1))  # past the last one it begins anew
    return late.unionByName(again).orderBy("_turn").limit(1).drop("_turn")


def people_batch(entry: DataFrame, entry_names: DataFrame, given_names: DataFrame, gender: str = "", described: bool = False, n: int = 50) -> DataFrame:
    """Open people with a known given name, in the fixed random order, and how many
    entries have their name."""
    rows = entry.where(S.not_full())
    if described:
        rows = rows.where("ext_desc <> ''")
    names = given_names.where(F.col("gender") == gender) if gender else given_names
    known = entry_names.join(names.select(F.col("id").alias("given_name_id")), "given_name_id", "left_semi")
    chosen = rows.join(known.select(F.col("entry_id").alias("id"), "random"), "id").orderBy("random", "id").limit(n)
    often = entry.join(chosen.select("ext_name").distinct(), "ext_name", "left_semi").groupBy("ext_name").agg(F.count("*").alias("name_count"))
    return chosen.join(often, "ext_name").select("id", "ext_name", "name_count")


def to_create(entry: DataFrame, catalog: int) -> DataFrame:
    """Entries of which a person said that they have no item yet."""
    return entry.where((F.col("catalog") == catalog) & (F.col("q") == -1) & (F.col("uid") > 0)).select("ext_id", "ext_name", "ext_desc", "ext_url", "type").orderBy("ext_name", "ext_id")


def tiles(entry: DataFrame, catalog: DataFrame, n: int, type_: str = "", start: float = 0.0, key: Column | None = None) -> DataFrame:
    """Preliminary matches to judge one by one, of catalogs with a primary property:
    what to show of each, and the claim that a yes makes."""
    own = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), "wd_prop", F.col("name").alias("catalog_name"))
    kind = {"person": F.col("type") == "Q5", "not_person": F.col("type") != "Q5"}.get(type_, F.lit(True))
    rows = entry.where((F.col("uid") == 0) & (F.col("ext_url") != "") & (F.col("ext_desc") != "") & kind).join(own, "catalog")
    shown = F.concat("ext_desc", F.lit("\n[from "), "catalog_name", F.lit(" catalog]"))
    item, prop = F.concat(F.lit("Q"), F.col("q").cast("string")), F.concat(F.lit("P"), F.col("wd_prop").cast("string"))
    chosen = sample(rows, n, start, key=key)
    return chosen.select("id", F.col("ext_name").alias("title"), F.col("ext_url").alias("url"), shown.alias("text"), item.alias("item"), prop.alias("property"), F.to_json(F.struct(F.col("ext_id").alias("value"))).alias("claim"))


def matched_download(entry: DataFrame, users: DataFrame, catalog: int) -> DataFrame:
    """A catalog's full matches for a text download, with who made them."""
    from lodestone.functions.text import scrub_cell

    names = users.select(F.col("id").alias("uid"), F.col("name").alias("username"))
    rows = entry.where(S.full() & (F.col("catalog") == catalog)).join(names, "uid", "left")
    return rows.select("q", *[scrub_cell(F.col(c)).alias(c) for c in ("ext_id", "ext_url", "ext_name")], "username")
