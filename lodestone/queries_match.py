"""Queries of matchers by condition and place, judgements, repairs and items to make."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.operators import control, decisions, items, maintenance, matchers, overview, references, report, scripts, store, sync
from lodestone.registry import FULL, PRIMARY, csv_array, query

NOW = "20250101000000"
_PRIMARY = PRIMARY.replace(" AND ", " AND c.")

# -- matchers -----------------------------------------------------------------

_LABELS = "SELECT id AS q, CASE id % 3 WHEN 0 THEN 'the ' || ext_name WHEN 1 THEN string_split(ext_name, ' ')[1] ELSE ext_name || 's' END AS label FROM entry"


def _labels(t):
    label = F.when(F.col("id") % 3 == 0, F.concat(F.lit("the "), "ext_name")).when(F.col("id") % 3 == 1, F.split("ext_name", " ")[0]).otherwise(F.concat("ext_name", F.lit("s")))
    return t.entry.select(F.col("id").alias("q"), label.alias("label"))


@query(f"""WITH l AS (SELECT * FROM ({_LABELS}) x WHERE q % 5 IN (1, 3) AND q % 2 = 0), h AS (SELECT DISTINCT l.q, e.id FROM l JOIN entry e ON e.q IS NULL AND (contains(lower(l.label), lower(e.ext_name)) OR contains(lower(e.ext_name), lower(l.label)))
           WHERE e.id NOT IN (SELECT entry_id FROM log WHERE action = 'remove_q')), s AS (SELECT q, min(id) AS entry_id FROM h GROUP BY q HAVING count(*) = 1)
           SELECT entry_id, array_to_string(list_sort(list(DISTINCT q)), ',') AS candidates FROM s GROUP BY 1""")
def conditions_match(t):
    """Items of class 900 + q % 5, where 901 and 903 are below 950, with an even claim."""
    say = lambda prop, value, where: t.entry.where(where).select(F.col("id").alias("q"), F.lit(prop).cast("long").alias("property"), value.alias("value"))
    claims = say(31, F.concat(F.lit("Q"), (F.col("id") % 5 + 900).cast("string")), "true").unionByName(say(17, F.lit("Q77"), "id % 2 = 0"))
    classes = t.spark.createDataFrame([(901, 279, "Q940"), (940, 279, "Q950"), (903, 279, "Q950"), (950, 279, "Q901")], "q long, property long, value string")
    found = matchers.by_conditions(t.entry, t.log, claims.unionByName(classes), _labels(t), [(31, 950), (17, 77)])
    return found.withColumn("candidates", csv_array("candidates"))


@query("SELECT id FROM entry WHERE q IS NULL AND id NOT IN (SELECT entry_id FROM log WHERE action = 'remove_q')")
def open_without_removal(t):
    return matchers.open_without_removal(t.entry, t.log).select("id")


_NEAR = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(p.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - l.lon) / 2), 2), 1.0)))"
_PLACES = "SELECT CAST(id + 5000 AS BIGINT) AS q, x.lat + (e.id % 3) * 0.002 AS lat, x.lon AS lon, CASE e.id % 2 WHEN 0 THEN 'Old ' || ext_name ELSE 'x' END AS label FROM entry e JOIN location x ON x.entry_id = e.id"
_BY_PLACE = f"""WITH p AS ({_PLACES}), k AS (SELECT id AS catalog, CASE id % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 300.0 ELSE 500.0 END AS reach FROM catalog WHERE id % 4 <> 3),
                h AS (SELECT DISTINCT e.id, e.q, p.q AS item FROM entry e JOIN k ON k.catalog = e.catalog JOIN location l ON l.entry_id = e.id JOIN p ON {_NEAR} <= k.reach AND (starts_with(lower(p.label), lower(e.ext_name)) OR ends_with(lower(p.label), lower(e.ext_name)))
                WHERE e.q IS NULL OR e.uid = 0)"""


def _places(t):
    at = t.location.join(t.entry.select(F.col("id").alias("entry_id"), "ext_name"), "entry_id")
    label = F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("Old "), "ext_name")).otherwise("x")
    places = at.select((F.col("entry_id") + 5000).alias("q"), (F.col("lat") + (F.col("entry_id") % 3) * 0.002).alias("lat"), "lon", label.alias("label"))
    kv = t.catalog.select(F.col("id").alias("catalog_id"), F.lit("allow_location_match").alias("kv_key"), F.when(F.col("id") % 4 != 3, "yes").otherwise("no").alias("kv_value"))
    reach = t.catalog.where("id % 3 <> 2").select(F.col("id").alias("catalog_id"), F.lit("location_distance").alias("kv_key"), F.when(F.col("id") % 3 == 0, "100m").otherwise("0.3km").alias("kv_value"))
    return matchers.by_place(t.entry, t.location, kv.unionByName(reach), places)


@query(f"{_BY_PLACE} SELECT id AS entry_id, min(item) AS q, 5 AS uid FROM h GROUP BY id HAVING count(*) = 1")
def coordinates_match(t):
    return _places(t)[0].withColumn("uid", F.col("uid").cast("int"))


@query(f"{_BY_PLACE} SELECT id AS entry_id, array_to_string(list_sort(list(item)), ',') AS candidates FROM h WHERE q IS NULL GROUP BY id HAVING count(*) BETWEEN 2 AND 11")
def coordinates_lists(t):
    return _places(t)[1].withColumn("candidates", csv_array("candidates"))


@query(f"""SELECT e.id, CASE WHEN {FULL.replace('q ', 'e.q ').replace('uid', 'e.uid')} AND k.q <> e.q THEN k.q ELSE e.q END AS q, CASE WHEN e.q > 0 AND e.uid > 0 AND k.q <> e.q THEN 4 ELSE e.uid END AS uid FROM entry e
           LEFT JOIN (SELECT value, max(q) AS q FROM kb_claims WHERE property = 215 GROUP BY 1) k ON e.catalog = 3 AND k.value = e.ext_id""")
def overwrite_from_claims(t):
    own = t.catalog.withColumn("wd_prop", F.when(F.col("id") == 3, 215).otherwise(F.col("wd_prop")).cast("long")).withColumn("wd_qual", F.lit(None).cast("long"))
    return sync.overwrite(t.entry, own, t.kb_claims, 3, NOW).select("id", "q", "uid")


@query("""SELECT id, coalesce(r.to_q, e.q) AS moved FROM entry e LEFT JOIN kb_redirects r ON r.from_q = e.q""")
def fix_matched_items_redirects(t):
    """Only the redirects of the composed repair: no item counts as gone."""
    every = t.entry.where("q > 0").select("q").unionByName(t.kb_redirects.select(F.col("to_q").alias("q"))).distinct()
    out = sync.fix_matched_items(t.entry, t.kb_redirects, every, t.kb_claims.where("false"))
    return out.select("id", F.col("q").alias("moved"))


@query(f"""SELECT e.id AS entry_id, e.q, c.wd_prop AS property, e.ext_id AS value FROM entry e JOIN catalog c ON c.id = e.catalog AND c.{_PRIMARY} WHERE e.q > 0 AND e.uid > 0
           AND NOT EXISTS (SELECT 1 FROM kb_claims k WHERE k.q = e.q AND k.q % 2 = 0 AND k.property = c.wd_prop)""")
def push_missing_claims(t):
    return sync.missing_claims(t.entry, t.catalog, t.kb_claims.where("q % 2 = 0"))


@query("SELECT entry_id, status FROM wd_matches WHERE entry_id NOT IN (SELECT id FROM entry WHERE catalog = 2) UNION ALL SELECT id, 'SAME' FROM entry WHERE catalog = 2")
def record_status(t):
    status = t.entry.where("catalog = 2").select(F.col("id").alias("entry_id"), F.lit("SAME").alias("status"))
    return sync.record_status(t.wd_matches, status).select("entry_id", "status")


@query("SELECT q, count(*) AS cnt FROM entry WHERE catalog = 5 AND q > 0 AND uid > 0 GROUP BY 1 HAVING count(*) > 1")
def duplicate_items(t):
    return report.duplicate_items(t.entry, 5)


@query("SELECT a.entry_id, a.aux_p, CAST(substr(a.aux_name, 2) AS BIGINT) AS creator_q FROM (SELECT entry_id, property AS aux_p, 'Q' || CAST(target_entry_id AS VARCHAR) AS aux_name FROM mnm_relation UNION SELECT entry_id, aux_p, aux_name FROM auxiliary) a JOIN entry e ON e.id = a.entry_id WHERE a.aux_p IN (50, 170) AND regexp_full_match(a.aux_name, 'Q[0-9]+')")
def vw_object_creator_aux(t):
    from types import SimpleNamespace

    from lodestone.operators import views

    made = t.mnm_relation.select("entry_id", F.col("property").alias("aux_p"), F.concat(F.lit("Q"), F.col("target_entry_id").cast("string")).alias("aux_name"))
    aux = t.auxiliary.select("entry_id", "aux_p", "aux_name").unionByName(made).distinct()
    return views.vw_object_creator_aux(SimpleNamespace(auxiliary=aux, entry=t.entry)).select("entry_id", "aux_p", "creator_q")


@query("SELECT id, name FROM catalog WHERE has_person_date NOT IN ('yes', 'no') AND id IN (SELECT e.catalog FROM entry e JOIN person_dates d ON d.entry_id = e.id WHERE e.type = 'Q5')")
def vw_catalogs_with_possible_dates_2(t):
    from lodestone.operators import views

    return views.vw_catalogs_with_possible_dates_2(t)


@query("SELECT id, CASE id % 3 WHEN 0 THEN 1900 + id % 90 END AS year FROM entry")
def sane_years(t):
    from lodestone.functions import dates

    said = F.when(F.col("id") % 3 == 0, F.concat(F.lit("born in "), (F.col("id") % 90 + 1900).cast("string"), F.lit(" or so"))).when(F.col("id") % 3 == 1, "no 12 year").otherwise("in 9999 or 1900")
    return t.entry.select("id", dates.sane_year(said, 2025).cast("long").alias("year"))


@query("SELECT id, CASE WHEN ext_name LIKE '%e%' THEN replace(ext_name, 'e', '&') ELSE ext_name END AS ext_name FROM entry")
def names_decoded(t):
    odd = t.entry.withColumn("ext_name", F.replace(F.col("ext_name"), F.lit("e"), F.when(F.col("id") % 2 == 0, "&amp;").otherwise("&#38;")))
    return maintenance.decode_names(odd).select("id", "ext_name")


@query("SELECT id FROM entry WHERE ext_name LIKE '%e%e%'")
def names_with_entities(t):
    odd = t.entry.withColumn("ext_name", F.regexp_replace("ext_name", "^(.*?)e(.*?)e", "$1&$2;"))
    return odd.where(F.col("ext_name").like("%&%;%")).select("id")


# -- reading ------------------------------------------------------------------


@query("SELECT type, count(*) AS cnt FROM issues WHERE status = 'OPEN' AND catalog IN (1, 2, 3) GROUP BY 1")
def issues_count(t):
    return report.open_issues(t.issues, catalogs=(1, 2, 3)).groupBy("type").agg(F.count("*").alias("cnt"))


@query("SELECT id, entry_id FROM issues WHERE status = 'OPEN' AND type = 'WD_DUPLICATE' AND (id * 7919 % 10007) / 10007.0 >= 0.25 ORDER BY (id * 7919 % 10007) / 10007.0, id LIMIT 10")
def issues_page(t):
    key = (F.col("id") * 7919 % 10007) / 10007.0
    return report.issue_page(t.issues, 10, 0.25, key, type_="WD_DUPLICATE").select("id", "entry_id")


@query("SELECT id, catalog FROM entry WHERE q = 7 AND catalog IN (SELECT id FROM catalog WHERE active = 1) AND catalog <> 3")
def entries_of_item(t):
    return report.entries_of_item(t.entry, t.catalog, 7, (3,)).select("id", "catalog")


@query("""SELECT id FROM (SELECT id FROM entry WHERE uid = 0 AND catalog = 3 AND (id * 7919 % 10007) / 10007.0 >= 0.5 AND catalog IN (SELECT id FROM catalog WHERE active = 1) ORDER BY (id * 7919 % 10007) / 10007.0, id LIMIT 1) x
          UNION ALL SELECT id FROM (SELECT id FROM entry WHERE q IS NULL AND catalog IN (SELECT id FROM catalog WHERE active = 1) ORDER BY (id * 7919 % 10007) / 10007.0, id LIMIT 1) y""")
def random_entries(t):
    """One of a catalog, and one after the last of all: there it begins anew."""
    key = (F.col("id") * 7919 % 10007) / 10007.0
    own = report.random_entry(t.entry, t.catalog, "prematched", own=3, start=0.5, key=key)
    return own.select("id").unionByName(report.random_entry(t.entry, t.catalog, start=2.0, key=key).select("id"))


@query("""SELECT e.id, e.ext_name, (SELECT count(*) FROM entry x WHERE x.ext_name = e.ext_name) AS name_count FROM entry e JOIN entry_names n ON n.entry_id = e.id JOIN given_names g ON g.id = n.given_name_id AND g.gender = 'female'
          WHERE (e.q IS NULL OR e.uid = 0) AND e.ext_desc <> '' ORDER BY n.random, e.id LIMIT 50""")
def people_batch(t):
    return report.people_batch(t.entry, t.entry_names, t.given_names, "female", True)


@query("SELECT ext_id, ext_name, type FROM entry WHERE q = -1 AND uid > 0 AND catalog = 6")
def entries_to_create(t):
    return report.to_create(t.entry, 6).select("ext_id", "ext_name", "type")


@query(f"""SELECT e.id, e.ext_name AS title, e.ext_desc || chr(10) || '[from ' || c.name || ' catalog]' AS text, 'Q' || CAST(e.q AS VARCHAR) AS item, 'P' || CAST(c.wd_prop AS VARCHAR) AS property FROM entry e
           JOIN catalog c ON c.id = e.catalog AND c.{_PRIMARY} WHERE e.uid = 0 AND e.ext_url <> '' AND e.ext_desc <> '' AND e.type <> 'Q5' ORDER BY (e.id * 7919 % 10007) / 10007.0, e.id LIMIT 12""")
def tiles_to_judge(t):
    found = report.tiles(t.entry, t.catalog, 12, "not_person", key=(F.col("id") * 7919 % 10007) / 10007.0)
    return found.select("id", "title", "text", "item", "property")


@query("SELECT e.id, c.ts FROM entry e JOIN entry_creation c ON c.entry_id = e.id WHERE e.catalog = 3")
def creation_times(t):
    made = t.entry_creation.select(F.col("entry_id").alias("id"), "ts")
    return t.entry.where("catalog = 3").select("id").join(made, "id")


@query("SELECT aux_p, count(*) AS cnt FROM auxiliary GROUP BY 1")
def auxiliary_properties(t):
    return t.auxiliary.groupBy("aux_p").agg(F.count("*").alias("cnt"))


@query("SELECT a.id, a.aux_name FROM auxiliary a WHERE a.aux_p = 227 AND a.id % 3 <> 0")
def auxiliary_of_property(t):
    """Identifiers of one property, without some rows."""
    gone = t.auxiliary.where("id % 3 = 0").select("id")
    return store.delete(t.auxiliary, gone, ["id"]).where("aux_p = 227").select("id", "aux_name")


@query("SELECT e.catalog, l.entry_id, l.lat FROM location l JOIN entry e ON e.id = l.entry_id WHERE e.catalog <> 2 ORDER BY (l.entry_id * 7919 % 10007) / 10007.0, l.entry_id LIMIT 30")
def coordinate_rows(t):
    """The rows that the matcher by place would take in a random order, some catalogs left out."""
    rows = t.location.join(t.entry.where("catalog <> 2").select(F.col("id").alias("entry_id"), "catalog"), "entry_id")
    return report.sample(rows, 30, column="entry_id", key=(F.col("entry_id") * 7919 % 10007) / 10007.0).select("catalog", "entry_id", "lat")


# -- judgements ---------------------------------------------------------------


@query("""SELECT id, CASE WHEN catalog = 3 AND q IS NULL THEN id % 5 + 1 ELSE q END AS q, CASE WHEN catalog = 3 AND q IS NULL THEN 0 ELSE uid END AS uid FROM entry""")
def suggest_items(t):
    lines = t.entry.where("catalog = 3").select(F.concat(F.lit(" "), "ext_id", F.lit(" | Q"), (F.col("id") % 5 + 1).cast("string")).alias("value"))
    lines = lines.unionByName(t.spark.createDataFrame([("bad line",), ("",), ("a|b|c",)], "value string"))
    return decisions.suggest(t.entry, lines, 3, NOW).select("id", "q", "uid")


@query("SELECT 'x' || CAST(id AS VARCHAR) AS value FROM entry WHERE id % 2 = 1")
def suggest_bad_lines(t):
    sign = F.when(F.col("id") % 2 == 0, "|").otherwise("")
    return decisions.parse_suggestions(t.entry.select(F.concat(F.lit("x"), sign, F.col("id").cast("string")).alias("value")))[1]


@query("""WITH n AS (SELECT id, CASE id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'n_a' END AS d FROM entry WHERE catalog = 5)
          SELECT e.id, CASE n.d WHEN 'yes' THEN e.q WHEN 'no' THEN NULL WHEN 'n_a' THEN -1 ELSE e.q END AS q, CASE WHEN n.d = 'yes' AND e.q IS NOT NULL THEN 55 WHEN n.d = 'n_a' THEN 55 WHEN n.d = 'no' AND e.q IS NOT NULL THEN NULL ELSE e.uid END AS uid
          FROM entry e LEFT JOIN n ON n.id = e.id""")
def judged_entries(t):
    decision = F.when(F.col("id") % 3 == 0, "yes").when(F.col("id") % 3 == 1, "no").otherwise("n_a")
    actions = t.entry.where("catalog = 5").select(F.col("id").alias("entry_id"), decision.alias("decision"), F.lit(55).cast("long").alias("uid"))
    return decisions.judged(t.entry, actions, t.log, NOW)[0].select("id", "q", "uid")


@query("SELECT id, CASE WHEN catalog = 3 AND uid = 0 AND q = 4 THEN NULL ELSE q END AS q FROM entry")
def remove_item_of_catalog(t):
    return decisions.remove_item(t.entry, 3, 4).select("id", "q")


@query("SELECT 'P' || CAST(id AS VARCHAR) AS ext_id FROM entry WHERE catalog <> 3 AND id < 200")
def match_misses(t):
    """Of identifiers to match in a catalog, those that it doesn't have."""
    asked = t.entry.where("id < 200").select("ext_id", F.lit(5).cast("long").alias("q"))
    return decisions.by_external_id(t.entry, asked, 3, 9)[1].select("ext_id")


@query("SELECT s.id, CASE WHEN e.catalog = 4 AND s.property = 101 AND s.text = 'view 3' AND s.q IS NULL THEN 42 ELSE s.q END AS q FROM statement_text s LEFT JOIN entry e ON e.id = s.entry_id")
def statement_text_item(t):
    return decisions.assign_text(t.statement_text, t.auxiliary, t.entry, 4, 101, "view 3", 42)[0].select("id", "q")


@query("""SELECT DISTINCT s.entry_id, s.property AS aux_p, 'Q42' AS aux_name FROM statement_text s JOIN entry e ON e.id = s.entry_id WHERE e.catalog = 4 AND s.property = 101 AND s.text = 'view 3' AND (s.q IS NULL OR s.q = 42)""")
def statement_text_identifiers(t):
    after = decisions.assign_text(t.statement_text, t.auxiliary, t.entry, 4, 101, "view 3", 42)[1]
    return after.where("aux_name = 'Q42'").select("entry_id", "aux_p", "aux_name")


@query("""SELECT entry_id, candidates FROM multi_match WHERE entry_id NOT IN (SELECT id FROM entry WHERE catalog = 2) UNION ALL SELECT id, '1,2' FROM entry WHERE catalog = 2""")
def candidate_lists_written(t):
    lists = t.entry.where("catalog = 2").select(F.col("id").alias("entry_id"), F.lit("1,2").alias("candidates"), F.lit(2).alias("candidate_count"))
    return decisions.write_lists(t.multi_match, lists, t.entry).select("entry_id", "candidates")


@query("""SELECT entry_id, type FROM issues UNION SELECT id, 'MISMATCH' FROM entry WHERE catalog = 2""")
def issues_written(t):
    new = t.entry.where("catalog = 2").select(F.col("id").alias("entry_id"), F.lit("MISMATCH").alias("type"), F.lit("{}").alias("json"))
    return decisions.write_issues(t.issues, new, t.entry).select("entry_id", "type").distinct()


@query("""SELECT entry_id, candidates FROM multi_match WHERE entry_id NOT IN (SELECT id FROM entry WHERE catalog = 2 AND id % 2 = 1)""")
def lists_after_matches(t):
    matched = t.entry.where("catalog = 2").select("id", (F.col("id") % 2 * 9).alias("new_uid"))
    return decisions.after_match(t.entry, matched, t.wd_matches, t.multi_match)[1].select("entry_id", "candidates")


# -- maintenance --------------------------------------------------------------


@query("SELECT id, aux_name FROM auxiliary WHERE NOT (aux_p = 227 AND substr(aux_name, 2, 1) = '3')")
def drop_flagged_identifiers(t):
    """Identifiers whose page carries a marker."""
    pages = t.auxiliary.where("aux_p = 227").select(F.col("aux_name").alias("value"), F.when(F.substring("aux_name", 2, 1) == "3", "x Undifferentiated y").when(F.col("id") % 2 == 0, "plain").alias("html"))
    return maintenance.drop_flagged(t.auxiliary, 227, maintenance.undifferentiated(pages, "Undifferentiated")).select("id", "aux_name")


@query("SELECT catalog, count(*) AS total FROM entry GROUP BY 1")
def overview_rebuilt(t):
    """Some counts fell below zero; they are counted anew."""
    right = overview.view(t.entry)
    broken = right.withColumns({"noq": F.when(F.col("catalog") % 3 == 0, -5).otherwise(F.col("noq")).cast("long"), "total": F.when(F.col("catalog") % 3 == 0, 0).otherwise(F.col("total")).cast("long")})
    return maintenance.rebuild_negative(broken, right).select("catalog", "total")


@query("""SELECT a.action, c.id AS catalog FROM catalog c, (VALUES ('match_person_dates'), ('match_on_birthdate'), ('match_on_deathdate')) a(action) WHERE c.active = 1 AND c.has_person_date NOT IN ('yes', 'no')
          AND c.id IN (SELECT e.catalog FROM entry e JOIN person_dates d ON d.entry_id = e.id)""")
def person_date_jobs_queued(t):
    return maintenance.person_date_jobs(maintenance.catalogs_with_dates(t.entry, t.person_dates, t.catalog))


# -- references, items --------------------------------------------------------

_STATEMENTS = "SELECT CAST(p_partkey AS VARCHAR) AS statement_id, p_partkey AS k, 'h' || CAST(p_partkey AS VARCHAR) AS hash FROM part"


@query(f"""SELECT statement_id, hash, CASE WHEN k % 6 = 0 THEN 'remove' ELSE 'replace' END AS action, CAST(CASE k % 6 WHEN 1 THEN 36578 END AS BIGINT) AS stated_in, CAST(CASE k % 6 WHEN 1 THEN 214 WHEN 2 THEN 227 END AS BIGINT) AS property,
           CASE k % 6 WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN 'a b' || CAST(k AS VARCHAR) END AS value FROM ({_STATEMENTS}) s WHERE k % 6 IN (0, 1, 2)""")
def reference_repairs(t):
    """By the number's rest of 6: the statement's own identifier, a URL of one
    identifier, one with a coded blank and a query, two URLs, a URL of two
    properties, and a URL of none."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    snak = lambda p, v: F.struct(F.lit(p).cast("long").alias("property"), v.alias("value"))
    url = lambda *parts: snak(854, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    snaks = (
        F.when(k % 6 == 0, F.array(snak(213, text), snak(813, F.lit("2024"))))
        .when(k % 6 == 1, F.array(url("http://www.viaf.example/viaf/", text, "/")))
        .when(k % 6 == 2, F.array(url("https://gnd.example/id?x=a%20b", text, "&lang=en")))
        .when(k % 6 == 3, F.array(url("https://viaf.example/viaf/", text), url("https://viaf.example/viaf/1")))
        .when(k % 6 == 4, F.array(url("https://both.example/", text)))
        .otherwise(F.array(url("https://nowhere.example/", text)))
    )
    rows = t.driver("part").select(text.alias("statement_id"), F.lit(213).cast("long").alias("main_property"), F.lit(True).alias("main_external"), F.concat(F.lit("h"), text).alias("hash"), snaks.alias("snaks"))
    templates = [(214, "https://viaf.example/viaf/$1"), (227, "http://gnd.example/id?x=$1"), (1, "https://both.example/$1"), (2, "https://both.example/$1"), (3, "https://doi.org/$1"), (4, "$1")]
    known = t.spark.createDataFrame(templates, "property long, template string")
    templates_www = known.unionByName(t.spark.createDataFrame([(214, "https://www.viaf.example/viaf/$1")], known.schema))
    return references.repairs(rows, templates_www, t.spark.createDataFrame([(214, 36578)], "property long, q long"))


@query(f"""SELECT CAST(e.id AS VARCHAR) AS statement_id, min(r.id) AS entry_id, CASE WHEN min(r.id) IS NULL THEN min(u.id) END AS catalog FROM entry e LEFT JOIN (SELECT x.id, x.q, c.wd_prop, x.ext_id FROM entry x JOIN catalog c ON c.id = x.catalog AND c.{_PRIMARY}) r
           ON r.q = 5 AND r.wd_prop = 212 AND r.ext_id = e.ext_id LEFT JOIN (SELECT wd_prop, min(id) AS id FROM catalog WHERE {PRIMARY} GROUP BY 1 HAVING count(*) = 1) u ON u.wd_prop = 212 GROUP BY e.id""")
def reference_summaries(t):
    edits = t.entry.select(F.col("id").cast("string").alias("statement_id"), F.lit(212).cast("long").alias("property"), F.col("ext_id").alias("value"))
    found = references.edit_summaries(edits, t.entry, t.catalog, edits.select("statement_id", F.lit(5).cast("long").alias("q")))
    return found.select("statement_id", "entry_id", "catalog")


@query("""SELECT entry_id, aux_p, '{"property":"P' || CAST(aux_p AS VARCHAR) || '","type":"' || CASE aux_p WHEN 17 THEN 'wikibase-entityid' ELSE 'string' END || '","value":"' || CASE aux_p WHEN 17 THEN 'Q' || CAST(entry_id % 9 AS VARCHAR) ELSE aux_name END || '"}' AS snak
          FROM (SELECT DISTINCT entry_id, aux_p, CASE aux_p WHEN 17 THEN '' ELSE aux_name END AS aux_name FROM auxiliary) a WHERE aux_p IN (17, 214, 227)""")
def claims_of_identifiers(t):
    """Identifiers, items and datatypes that text can't give."""
    value = F.when(F.col("aux_p") == 17, F.concat(F.lit("Q"), (F.col("entry_id") % 9).cast("string"))).otherwise(F.col("aux_name"))
    rows = t.auxiliary.select("entry_id", "aux_p", value.alias("aux_name")).distinct()
    kinds = t.spark.createDataFrame([(17, "wikibase-item"), (214, "external-id"), (227, "string"), (1207, "quantity"), (1273, "time")], "property long, datatype string")
    return items.claims_of_aux(rows, kinds)


@query(f"""SELECT e.id AS entry_id, e.q, c.wd_prop AS property, e.ext_id AS value FROM entry e JOIN catalog c ON c.id = e.catalog AND c.wd_prop IS NOT NULL AND c.wd_qual IS NULL WHERE e.q > 0
           AND NOT EXISTS (SELECT 1 FROM kb_claims k WHERE k.q = e.q AND k.property = c.wd_prop AND k.value = e.ext_id)""")
def match_claims(t):
    return items.match_claims(t.entry, t.catalog, t.kb_claims, NOW).select("entry_id", "q", "property", "value")


def _parts(t, auxiliary=None):
    kv = t.catalog.where("id % 5 = 0").select(F.col("id").alias("catalog_id"), F.lit("no_descriptions").alias("kv_key"), F.lit("1").alias("kv_value"))
    kv = kv.unionByName(t.catalog.where("id % 5 = 1").select(F.col("id"), F.lit("use_description_for_new"), F.lit("0")).toDF("catalog_id", "kv_key", "kv_value"))
    kv = kv.unionByName(t.catalog.where("id % 5 = 2").select(F.col("id"), F.lit("no_dates_import"), F.lit("1")).toDF("catalog_id", "kv_key", "kv_value"))
    kinds = t.spark.createDataFrame([(214, "external-id"), (227, "external-id")], "property long, datatype string")
    return items.parts(t.entry, t.catalog, kv, t.aliases, t.descriptions, t.person_dates, t.location, t.auxiliary if auxiliary is None else auxiliary, kinds)


@query("""SELECT e.id AS entry_id, 'label' AS part, CASE e.type WHEN 'Q5' THEN 'mul' ELSE 'en' END AS language, e.ext_name AS value FROM entry e
          UNION SELECT e.id, 'description', 'en', e.ext_desc FROM entry e WHERE e.catalog % 5 NOT IN (0, 1) AND e.ext_desc <> ''
          UNION SELECT d.entry_id, 'description', d.language, d.label FROM descriptions d JOIN entry e ON e.id = d.entry_id WHERE e.catalog % 5 <> 0 AND d.label <> '' AND NOT (d.language = 'en' AND e.catalog % 5 <> 1 AND e.ext_desc <> '')
          UNION SELECT a.entry_id, 'alias', a.language, a.label FROM aliases a JOIN entry e ON e.id = a.entry_id WHERE a.label <> e.ext_name AND a.label <> ''""")
def item_texts(t):
    return _parts(t).where("part <> 'claim'")


@query("""SELECT entry_id, property, count(*) AS cnt FROM (SELECT id AS entry_id, 31 AS property FROM entry WHERE type <> '' UNION ALL SELECT e.id, c.wd_prop FROM entry e JOIN catalog c ON c.id = e.catalog AND c.wd_prop IS NOT NULL AND c.wd_qual IS NULL
          UNION ALL SELECT d.entry_id, 569 FROM person_dates d JOIN entry e ON e.id = d.entry_id WHERE e.catalog % 5 <> 2 AND d.born <> '' UNION ALL SELECT d.entry_id, 570 FROM person_dates d JOIN entry e ON e.id = d.entry_id WHERE e.catalog % 5 <> 2 AND d.died <> ''
          UNION ALL SELECT l.entry_id, 625 FROM location l JOIN entry e ON e.id = l.entry_id) x GROUP BY 1, 2""")
def item_claims(t):
    """Claims by property, identifiers noted on entries aside."""
    prop = F.regexp_extract("value", '"property":"P([0-9]+)"', 1).cast("long")
    rows = _parts(t, t.auxiliary.where("false")).where("part = 'claim'").select("entry_id", prop.alias("property"))
    return rows.groupBy("entry_id", "property").agg(F.count("*").alias("cnt"))


@query("""WITH RECURSIVE a AS (SELECT DISTINCT entry_id, aux_p, aux_name FROM (SELECT id AS entry_id, 214 AS aux_p, CAST(id // 3 AS VARCHAR) AS aux_name FROM entry UNION ALL SELECT id, 227, CAST((id + 1) // 7 AS VARCHAR) FROM entry WHERE id % 7 IN (0, 6)) x),
          n AS (SELECT DISTINCT x.entry_id, y.entry_id AS other FROM a x JOIN a y ON x.aux_p = y.aux_p AND x.aux_name = y.aux_name), r(entry_id, item, hops) AS (SELECT entry_id, entry_id, 0 FROM a UNION SELECT n.entry_id, r.item, r.hops + 1 FROM r JOIN n ON n.other = r.entry_id WHERE n.entry_id > r.item AND r.hops < 7)
          SELECT entry_id, min(item) AS item FROM r GROUP BY 1""")
def items_of_entries(t):
    """Entries in threes by one identifier, which another one joins here and there."""
    by3 = t.entry.select(F.col("id").alias("entry_id"), F.lit(214).cast("long").alias("aux_p"), F.floor(F.col("id") / 3).cast("string").alias("aux_name"))
    by7 = t.entry.where("id % 7 IN (0, 6)").select(F.col("id").alias("entry_id"), F.lit(227).cast("long").alias("aux_p"), F.floor((F.col("id") + 1) / 7).cast("string").alias("aux_name"))
    return items.same_things(t.entry, by3.unionByName(by7))


@query("""SELECT id - id % 3 AS item, CAST(count(*) AS BIGINT) AS labels FROM (SELECT DISTINCT id - id % 3 AS id, type = 'Q5' AS p FROM entry) x GROUP BY 1""")
def items_merged(t):
    """One label for each language of entries that are merged in threes."""
    things = items.same_things(t.entry, t.entry.select(F.col("id").alias("entry_id"), F.lit(214).cast("long").alias("aux_p"), F.floor(F.col("id") / 3).cast("string").alias("aux_name")))
    whole = items.as_json(items.merged(_parts(t).where("part = 'label'"), things))
    labels = F.from_json("data", "label array<struct<language:string,value:string>>")["label"]
    return whole.select("item", F.size(labels).cast("long").alias("labels"))


@query("""SELECT id FROM entry WHERE catalog = 3 AND q IS NULL AND ext_name NOT IN (SELECT text FROM kb_terms WHERE q % 4 = 0)""")
def items_to_make(t):
    return items.to_make(t.entry.where("catalog = 3"), t.aliases, t.kb_terms.where("q % 4 = 0"))[1].select("id")


@query("SELECT 'c' || CAST(n_regionkey AS VARCHAR) AS code, CAST(max(n_nationkey) AS BIGINT) AS q FROM nation GROUP BY 1")
def codes_of_items(t):
    rows = t.driver("nation").select(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("code"), F.col("n_nationkey").cast("long").alias("q"), F.col("n_nationkey").alias("seq"))
    return control.replace_table(items.label_codes(rows), 5)


# -- scripts ------------------------------------------------------------------

_AUX_SCRIPT = """
def run(o):
    found = re_match("Brand#([0-9])([0-9])", o.ext_desc)
    if found:
        setAux(176, found[0] + "-" + found[1])
    if re_test("STEEL", o.ext_desc):
        setAux(186, "Q11427")
        setLocation(o.id % 90, 1)
"""
_DATE_SCRIPT = """
def run(o):
    years = [x[0] for x in re_find_all("[0-9]{4}", o.ext_desc)]
    return dp(years[0]), dp("7. 3. " + years[1])
"""
_PAGE_SCRIPT = """
def run(o, html):
    for words in re_find_all("<p[ >]", html)[:2]:
        setAux(1, str(len(html) > 0))
    setName(o.ext_name + "!")
"""


@query("""SELECT id AS entry_id, 176 AS property, regexp_extract(ext_desc, 'Brand#([0-9])', 1) || '-' || regexp_extract(ext_desc, 'Brand#[0-9]([0-9])', 1) AS value FROM entry WHERE catalog = 3 AND regexp_matches(ext_desc, 'Brand#[0-9][0-9]') UNION ALL SELECT id, 186, 'Q11427' FROM entry WHERE catalog = 3 AND contains(ext_desc, 'STEEL')""")
def script_identifiers(t):
    found = scripts.commands_from_description(t.entry, _AUX_SCRIPT, 3)
    return found.where("kind = 'setAux'").select("entry_id", "property", "value")


@query("""SELECT id AS entry_id, CAST(1900 + id % 50 AS VARCHAR) AS born, CAST(1940 + id % 50 AS VARCHAR) || '-03-07' AS died FROM entry WHERE catalog = 4 AND type = 'Q5'
          UNION ALL SELECT entry_id, born, died FROM person_dates WHERE entry_id NOT IN (SELECT id FROM entry WHERE catalog = 4)""")
def script_person_dates(t):
    described = t.entry.withColumn("ext_desc", F.concat(F.lit("lived "), (F.col("id") % 50 + 1900).cast("string"), F.lit(" to "), (F.col("id") % 50 + 1940).cast("string")))
    return scripts.replace_person_dates(t.person_dates, described, _DATE_SCRIPT, 4).select("entry_id", "born", "died")


@query("SELECT e.id AS entry_id, e.ext_name || '!' AS name FROM pages p JOIN entry e ON e.id = p.page_id + 1 WHERE e.catalog = 5")
def script_pages(t):
    """Pages stand for the entries with the next number."""
    pages = t.driver("pages").select(F.concat(F.lit("http://p/"), (F.col("page_id") + 1).cast("string")).alias("url"), "html")
    entry = t.entry.withColumn("ext_url", F.concat(F.lit("http://p/"), F.col("id").cast("string")))
    found = scripts.commands_from_pages(entry, pages, _PAGE_SCRIPT, 5)
    return found.where("kind = 'setName'").select("entry_id", F.col("value").alias("name"))


@query("SELECT id, CASE WHEN catalog = 3 AND contains(ext_desc, 'STEEL') THEN CAST(id % 90 AS DOUBLE) ELSE l.lat END AS lat FROM entry e LEFT JOIN location l ON l.entry_id = e.id WHERE l.lat IS NOT NULL OR (catalog = 3 AND contains(ext_desc, 'STEEL'))")
def script_written(t):
    """What a script says is written under the rules of commands."""
    from lodestone.operators import commands

    tables = {"auxiliary": t.auxiliary, "location": t.location, "person_dates": t.person_dates, "aliases": t.aliases}
    after = commands.write(tables, scripts.commands_from_description(t.entry, _AUX_SCRIPT, 3))["location"]
    return after.join(t.entry.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select(F.col("entry_id").alias("id"), "lat")
