"""The operators of this library as queries over the fixture views.

Each query runs an operator over whole tables; its oracle is the same question as
SQL for another engine, over the same views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import dates, geo, text
from lodestone.operators import candidates, commands, decisions, maintenance, matchers, overview, report, store, sync, views
from lodestone.plans.entry_query import Download, EntryQuery, Listing, Search
from lodestone.registry import FULL as _FULL
from lodestone.registry import ORACLES, QUERIES, csv, query
from lodestone.registry import PRIMARY as _PRIMARY
from lodestone.registry import csv_array as _csv_array
from lodestone.sources import meta_entry, scraper
from lodestone.streaming import feeds

__all__ = ["ORACLES", "QUERIES"]

_OPEN = "(q IS NULL OR uid = 0)"
_KEY = "lower(rtrim(ext_name))"
_ACTIVE = "catalog IN (SELECT id FROM catalog WHERE active = 1)"


# -- states, overview ---------------------------------------------------------

_COUNTS = f"""catalog, count(*) AS total, count(*) FILTER (q IS NULL) AS noq, count(*) FILTER (uid = 0) AS autoq, count(*) FILTER (q = 0) AS na,
              count(*) FILTER (q = -1) AS nowd, count(*) FILTER ({_FULL}) AS manual"""
_CLASS = """CASE WHEN uid IS NULL OR q IS NULL THEN 'noq' WHEN uid = 0 THEN 'autoq' WHEN q = 0 THEN 'na' WHEN q = -1 THEN 'nowd' WHEN uid > 0 THEN 'manual' ELSE 'noq' END"""
_BY_CLASS = ", ".join(f"count(*) FILTER (b = '{b}') AS {b}" for b in S.BUCKETS)


@query(f"""SELECT {_COUNTS}, array_to_string(list_sort(list(DISTINCT type)), '|') AS types, coalesce((SELECT count(*) FROM multi_match m WHERE m.catalog = entry.catalog), 0) AS multi_match
           FROM entry GROUP BY catalog""")
def overview_buckets(t):
    return overview.refresh(t.entry, t.multi_match)


@query(f"SELECT catalog, count(*) AS total, {_BY_CLASS} FROM (SELECT catalog, {_CLASS} AS b FROM entry) e GROUP BY catalog")
def overview_classified(t):
    return overview.classified(t.entry)


@query(f"""SELECT catalog, count(*) AS total, count(*) FILTER (q IS NULL) AS noq, count(*) FILTER (q IS NOT NULL AND uid = 0) AS autoq, count(*) FILTER (q = 0 AND uid > 0) AS na,
           count(*) FILTER (q = -1 AND uid > 0) AS nowd, count(*) FILTER ({_FULL}) AS manual FROM entry GROUP BY catalog""")
def vw_overview(t):
    return overview.view(t.entry)


@query(f"""SELECT catalog, count(*) AS total, {_BY_CLASS} FROM (SELECT catalog, CASE WHEN uid = 0 THEN 'noq' ELSE {_CLASS} END AS b FROM entry) e GROUP BY catalog""")
def overview_delta(t):
    """Counts after all preliminary matches went, by the change alone."""
    before = t.entry.where(S.preliminary())
    after, _ = decisions.unmatch(before, F.lit(True))
    return overview.apply_delta(overview.classified(t.entry), overview.delta(before, after))


@query(f"""SELECT count(*) FILTER (q IS NULL) AS unmatched, count(*) FILTER (q > 0 AND uid = 0) AS preliminary, count(*) FILTER ({_FULL}) AS full_, count(*) FILTER (q IS NULL OR ({_FULL})) AS either FROM entry""")
def match_state_counts(t):
    states = {"unmatched": (True, False, False), "preliminary": (False, True, False), "full_": (False, False, True), "either": (True, False, True)}
    return t.entry.agg(*[F.count_if(S.match_state(*on)).alias(n) for n, on in states.items()])


@query("""SELECT c.id, c.name, c.active, e.total, e.noq, u.name AS username FROM catalog c LEFT JOIN (SELECT catalog, count(*) AS total, count(*) FILTER (q IS NULL) AS noq FROM entry GROUP BY catalog) e
          ON e.catalog = c.id LEFT JOIN users u ON u.id = c.owner WHERE c.active >= 1""")
def catalog_overview(t):
    return overview.listing(t.catalog, overview.view(t.entry), t.users).select("id", "name", "active", "total", "noq", "username")


# -- entry queries ------------------------------------------------------------


@query("""SELECT id, catalog, ext_id, ext_name, q FROM entry WHERE catalog = 3 AND q IS NULL AND ext_desc <> '' AND regexp_matches(ext_name, '[aeiou] ')
          AND id IN (SELECT entry_id FROM person_dates WHERE year_born <> '' OR year_died <> '')""")
def entry_query_dates(t):
    q = EntryQuery(catalog=3, state=(True, False, False), description=True, name_regexp="[aeiou] ", min_dates=1)
    return q.run(t.entry, t.person_dates, t.auxiliary, t.location).select("id", "catalog", "ext_id", "ext_name", "q")


@query("""SELECT id, catalog, type FROM entry WHERE type = 'Q5' AND id IN (SELECT entry_id FROM auxiliary GROUP BY entry_id HAVING count(*) >= 20)""")
def entry_query_min_aux(t):
    return EntryQuery(type="Q5", min_aux=20).run(t.entry, t.person_dates, t.auxiliary, t.location).select("id", "catalog", "type")


@query("""SELECT id, ext_id FROM entry WHERE id IN (SELECT entry_id FROM location) AND id IN (SELECT entry_id FROM person_dates WHERE year_born <> '' AND year_died <> '')
          AND lower(ext_desc) LIKE '%brand#1%' ORDER BY id LIMIT 20 OFFSET 5""")
def entry_query_page(t):
    q = EntryQuery(coordinates=True, min_dates=2, hint="Brand#1", limit=20, offset=5)
    return q.run(t.entry, t.person_dates, t.auxiliary, t.location).select("id", "ext_id")


@query("SELECT id, ext_name FROM entry WHERE catalog = 7 AND ext_id IN ('P7', 'P32', 'P57', 'X')")
def entry_query_ext_ids(t):
    q = EntryQuery(catalog=7, ext_ids=("P7", "P32", "P57", "X"))
    return q.run(t.entry, t.person_dates, t.auxiliary, t.location).select("id", "ext_name")


@query(f"SELECT id, b FROM (SELECT id, catalog, lower(ext_name) AS name, {_CLASS} AS b FROM entry) e WHERE catalog = 4 AND b IN ('noq', 'na') AND name LIKE '%e%'")
def entry_listing(t):
    rows = Listing(4, show_autoq=False, show_userq=False, show_nowd=False, title="e").run(t.entry, t.multi_match)
    return rows.select("id", S.bucket().alias("b"))


@query(f"SELECT id FROM entry WHERE catalog = 6 AND {_OPEN} AND id IN (SELECT entry_id FROM multi_match)")
def entry_listing_multiple(t):
    return Listing(6, multiple=True).run(t.entry, t.multi_match).select("id")


@query(f"""SELECT id FROM entry WHERE {_ACTIVE} AND q IS NULL AND catalog <> 2 AND (list_contains(string_split_regex(lower(ext_name), '[^a-z0-9]+'), 'blue')
           OR list_contains(string_split_regex(lower(ext_desc), '[^a-z0-9]+'), 'blue') OR list_contains(string_split_regex(lower(ext_desc), '[^a-z0-9]+'), 'brand')) ORDER BY id LIMIT 100""")
def search_words(t):
    blue = Search(("Blue",), descriptions=True, matched=False, exclude=(2,), limit=1 << 30)
    brand = Search(("brand",), descriptions=True, matched=False, exclude=(2,), limit=1 << 30)
    return blue.run(t.entry, t.catalog).unionByName(brand.run(t.entry, t.catalog)).select("id").distinct().orderBy("id").limit(100)


@query("""SELECT e.id AS entry_id, e.catalog, e.ext_id AS external_id, e.q, e.ext_name AS name, e.type AS entry_type, e.ext_url, u.name AS matched_by, d.born, d.died, l.lat, l.lon
          FROM entry e LEFT JOIN users u ON u.id = e.uid LEFT JOIN person_dates d ON d.entry_id = e.id LEFT JOIN location l ON l.entry_id = e.id
          WHERE e.catalog IN (1, 2, 3) AND e.uid <> 0 AND e.q IS NOT NULL""")
def download_table(t):
    spec = Download((1, 2, 3), ext_url=True, dates=True, location=True, user=True, hide=("automatched", "unmatched"))
    return spec.run(t.entry, t.users, t.person_dates, t.location, t.multi_match)


@query("SELECT e.q, e.ext_id, e.ext_url, e.ext_name, u.name AS username FROM entry e LEFT JOIN users u ON u.id = e.uid WHERE e.q > 0 AND e.uid > 0 AND e.catalog = 5")
def download_matched(t):
    return report.matched_download(t.entry, t.users, 5)


@query("""SELECT entry_id FROM auxiliary WHERE aux_p = 214 AND aux_name = 'A3-3' UNION SELECT e.id FROM entry e JOIN catalog c ON c.id = e.catalog AND c.active = 1 AND c.wd_prop = 214 WHERE e.ext_id = 'A3-3'""")
def entries_by_identifier(t):
    return views.vw_p214(t).where("value = 'A3-3'").select("entry_id").distinct()


# -- candidates ---------------------------------------------------------------

_PEOPLE = "SELECT e.*, d.year_born, d.year_died, d.born, d.died, lower(rtrim(e.ext_name)) AS name FROM entry e JOIN person_dates d ON d.entry_id = e.id"


@query(f"""SELECT name, year_born, year_died, count(DISTINCT catalog) AS cnt, {csv()} AS entry_ids FROM ({_PEOPLE}) p WHERE {_ACTIVE} AND type = 'Q5' AND year_born <> '' AND year_died <> ''
           GROUP BY 1, 2, 3 HAVING count(DISTINCT catalog) >= 2 AND max(CASE WHEN {_FULL} THEN 1 ELSE 0 END) = 0""")
def common_names_dates(t):
    return candidates.common_names_dates(t.entry, t.catalog, t.person_dates, least=2).listed()


@query(f"""SELECT name, year_born, count(*) AS cnt, {csv()} AS entry_ids FROM ({_PEOPLE}) p WHERE {_ACTIVE} AND q IS NULL AND TRY_CAST(year_born AS INT) < 2030 AND regexp_matches(ext_name, '[^ ] [^ ]')
           GROUP BY 1, 2 HAVING count(*) >= 2""")
def common_names_birth_year(t):
    return candidates.common_names_birth_year(t.entry, t.catalog, t.person_dates, least=2, before=2030).listed()


@query(f"""SELECT {_KEY} AS name, count(DISTINCT catalog) AS cnt, {csv()} AS entry_ids FROM entry WHERE {_ACTIVE} AND q IS NULL AND type = 'Q5'
           GROUP BY 1 HAVING count(DISTINCT catalog) >= 2""")
def common_names_human(t):
    """Every name gets two more words, so that it has the three that the operator asks for."""
    entry = t.entry.withColumn("ext_name", F.concat("ext_name", F.lit(" john smith")))
    found = candidates.common_names_human(entry, t.catalog, least=2).listed()
    return found.withColumn("name", F.regexp_replace("name", " john smith$", ""))


@query(f"""SELECT {_KEY} AS name, count(DISTINCT catalog) AS cnt, {csv()} AS entry_ids FROM entry WHERE {_ACTIVE} AND q IS NULL AND type = 'Q16521' AND regexp_full_match(ext_name, '[^ ]+ [^ ]+')
           GROUP BY 1 HAVING count(DISTINCT catalog) >= 2""")
def common_names_taxon(t):
    return candidates.common_taxa(t.entry, t.catalog, least=2).listed()


@query(f"""SELECT {_KEY} AS name, count(DISTINCT catalog) AS cnt, {csv()} AS entry_ids FROM entry WHERE {_ACTIVE} AND q IS NULL GROUP BY 1 HAVING count(DISTINCT catalog) BETWEEN 3 AND 6""")
def vw_common_names(t):
    return views.vw_common_names(t)


@query(f"""SELECT lower(rtrim(w.ext_name)) AS name, c.q AS creator, count(DISTINCT w.catalog) AS cnt, {csv('w.id')} AS entry_ids FROM entry w JOIN mnm_relation r ON r.entry_id = w.id AND r.property = 170
           JOIN entry c ON c.id = r.target_entry_id AND c.q > 0 AND c.uid > 0 WHERE w.catalog IN (SELECT id FROM catalog WHERE active = 1) AND w.q IS NULL AND w.type = 'Q838948'
           GROUP BY 1, 2 HAVING count(DISTINCT w.catalog) >= 2 AND count(DISTINCT w.id) = count(DISTINCT w.ext_url)""")
def common_names_artwork(t):
    return candidates.common_artwork(t.entry, t.catalog, t.mnm_relation).listed()


@query(f"""SELECT aux_p, aux_name, count(*) AS cnt, count(*) FILTER (q IS NULL) AS unmatched, {csv('entry_id', ' FILTER (q IS NULL)')} AS entry_ids
           FROM auxiliary a JOIN entry e ON e.id = a.entry_id WHERE aux_p IN (214, 227, 1207, 1273, 244) GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (q IS NULL) > 0""")
def common_aux(t):
    return candidates.common_aux(t.auxiliary, t.entry).listed()


@query(f"""SELECT aux_p, aux_name, count(*) AS cnt, {csv()} AS entry_ids FROM (SELECT e.id, c.wd_prop AS aux_p, e.ext_id AS aux_name, e.q FROM entry e JOIN catalog c ON c.id = e.catalog AND c.{_PRIMARY.replace(' AND ', ' AND c.')}
           UNION ALL SELECT e.id, a.aux_p, a.aux_name, e.q FROM auxiliary a JOIN entry e ON e.id = a.entry_id) x GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (q > 0) = 0""")
def aux_candidates(t):
    return candidates.aux_candidates(t.auxiliary, t.entry, t.catalog, least=2).listed()


@query(f"""SELECT DISTINCT r.entry_id, r.property AS aux_p, 'Q' || CAST(e.q AS VARCHAR) AS aux_name FROM mnm_relation r JOIN entry e ON e.id = r.target_entry_id AND e.{_FULL.replace('uid', 'e.uid')}
           WHERE property IN (50, 170)""")
def relations_as_aux(t):
    return candidates.relations_as_aux(t.mnm_relation, t.entry, t.auxiliary)


@query(f"""SELECT aux_p, aux_name, {csv('entry_id')} AS entry_ids FROM auxiliary WHERE aux_p IN (214, 227, 1207, 1273, 244) GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) > sum(entry_is_matched)""")
def crossmatch_groups(t):
    return candidates.crossmatch_groups(t.auxiliary).listed()


_RULES = [("steel", 186, "Q11427", ""), ("^promo", 31, "Q5", "Q5"), ("brand#1[12]", 176, "Q1", "Q16521")]


@query(f"""SELECT DISTINCT e.id AS entry_id, CAST(r.property AS BIGINT) AS aux_p, r.value AS aux_name FROM entry e JOIN (VALUES {', '.join(map(str, _RULES))}) r(rx, property, value, tc)
           ON regexp_matches(lower(e.ext_desc), r.rx) AND (r.tc = '' OR r.tc = e.type)""")
def description_rules(t):
    rules = t.spark.createDataFrame(_RULES, "rx string, property long, value string, type_constraint string")
    return candidates.describe_rules(t.entry, rules, t.auxiliary)


# -- matchers -----------------------------------------------------------------

_META = "SELECT q FROM kb_claims WHERE property = 31 AND value IN ('Q4167410', 'Q11266439', 'Q4167836', 'Q13406463', 'Q22808320', 'Q17362920')"


@query(f"""SELECT id AS entry_id, array_to_string(list_slice(list_sort(list(DISTINCT k.q)), 1, 11), ',') AS candidates FROM (SELECT id, ext_name AS text FROM entry WHERE q IS NULL
           UNION SELECT e.id, a.label FROM aliases a JOIN entry e ON e.id = a.entry_id WHERE e.q IS NULL) n JOIN kb_terms k ON k.text = n.text WHERE k.q NOT IN ({_META}) GROUP BY id""")
def automatch_by_label(t):
    return matchers.by_label(t.entry, t.aliases, t.kb_terms, t.kb_claims).withColumn("candidates", _csv_array("candidates"))


@query("""SELECT id AS entry_id, array_to_string(list_slice(list(q ORDER BY rank, q), 1, 11), ',') AS candidates FROM (SELECT n.id, k.q, min(n.rank) AS rank FROM (SELECT id, ext_name AS text, 0 AS rank FROM entry WHERE q IS NULL
          UNION ALL SELECT e.id, a.label, 1 FROM aliases a JOIN entry e ON e.id = a.entry_id WHERE e.q IS NULL) n JOIN (SELECT DISTINCT text, q FROM kb_terms) k ON k.text = n.text GROUP BY n.id, k.q) h GROUP BY id""")
def automatch_by_search(t):
    return matchers.by_search(t.entry, t.aliases, t.kb_terms).withColumn("candidates", _csv_array("candidates"))


@query("""SELECT e.id AS entry_id, min(s.q) AS q FROM entry e JOIN catalog c ON c.id = e.catalog JOIN kb_sitelinks s ON s.title = e.ext_name AND s.site = c.search_wp || 'wiki'
          WHERE e.q IS NULL AND e.id NOT IN (SELECT entry_id FROM log WHERE action = 'remove_q') GROUP BY e.id""")
def automatch_by_sitelink(t):
    return matchers.by_sitelink(t.entry, t.catalog, t.kb_sitelinks, t.log)


@query(f"""SELECT e.id AS entry_id, k.q FROM entry e JOIN (SELECT {_KEY} AS name, type, min(q) AS q FROM entry WHERE {_FULL} GROUP BY 1, 2 HAVING count(DISTINCT q) = 1) k
           ON k.name = lower(rtrim(e.ext_name)) AND k.type = e.type WHERE e.q IS NULL""")
def from_other_catalogs(t):
    return matchers.from_other_catalogs(t.entry)


@query(f"""WITH p AS ({_PEOPLE} WHERE e.type = 'Q5'), hits AS (SELECT a.id AS entry_id, b.q FROM p a JOIN p b ON a.name = b.name AND a.year_born = b.year_born AND a.year_born <> ''
           WHERE (a.q IS NULL OR a.uid = 0) AND b.q > 0 AND b.uid > 0 AND a.catalog <> b.catalog AND b.catalog IN (SELECT id FROM catalog WHERE active = 1)
           UNION SELECT a.id, b.q FROM p a JOIN p b ON a.name = b.name AND a.year_died = b.year_died AND a.year_died <> ''
           WHERE (a.q IS NULL OR a.uid = 0) AND b.q > 0 AND b.uid > 0 AND a.catalog <> b.catalog AND b.catalog IN (SELECT id FROM catalog WHERE active = 1))
           SELECT entry_id, min(q) AS q FROM hits GROUP BY 1 HAVING count(DISTINCT q) = 1""")
def people_birth_year(t):
    return matchers.by_birth_year(t.entry, t.catalog, t.person_dates)


@query(f"""WITH p AS ({_PEOPLE} WHERE e.type = 'Q5' AND year_born <> '' AND e.catalog IN (SELECT id FROM catalog WHERE active = 1))
           SELECT a.id AS entry_id, min(b.q) AS q FROM p a JOIN p b ON a.name = b.name AND a.year_born = b.year_born WHERE a.q > 0 AND a.uid = 0 AND b.q > 0 AND b.uid > 0 AND a.q <> b.q
           AND a.id NOT IN (SELECT entry_id FROM log WHERE action = 'remove_q') GROUP BY 1""")
def year_born_retarget(t):
    return matchers.year_born_retarget(t.entry, t.catalog, t.person_dates, t.log)


@query(f"""WITH p AS (SELECT *, lower(rtrim(ext_name)) AS name, '19' || CAST(10 + id % 3 AS VARCHAR) || '-01-02' AS born, '1980-05-06' AS died FROM entry) SELECT a.id AS entry_id, k.q FROM p a JOIN (SELECT name, born, died, min(q) AS q FROM p WHERE {_FULL}
           GROUP BY 1, 2, 3 HAVING count(DISTINCT q) = 1) k ON k.name = a.name AND k.born = a.born AND k.died = a.died WHERE a.q IS NULL OR a.uid = 0""")
def name_full_dates(t):
    born = F.concat(F.lit("19"), (F.col("id") % 3 + 10).cast("string"), F.lit("-01-02"))
    lives = t.entry.select(F.col("id").alias("entry_id"), born.alias("born"), F.lit("1980-05-06").alias("died"))
    return matchers.by_name_and_dates(t.entry, lives)


@query(f"""SELECT e.id AS entry_id, k.q FROM entry e JOIN (SELECT {_KEY} AS name, min(q) AS q FROM entry WHERE {_FULL} AND type = 'Q5' GROUP BY 1 HAVING count(DISTINCT q) = 1) k
           ON k.name = lower(rtrim(e.ext_name)) WHERE e.q IS NULL AND e.type = 'Q5'""")
def automatch_unique_name(t):
    return matchers.by_unique_name(t.entry)


@query(f"""WITH r AS (SELECT a.aux_p, a.aux_name, e.id, e.q, e.uid FROM auxiliary a JOIN entry e ON e.id = a.entry_id WHERE aux_p IN (214, 227, 1207, 1273, 244)),
           k AS (SELECT aux_p, aux_name, min(q) AS item FROM r WHERE {_FULL} GROUP BY 1, 2 HAVING count(DISTINCT q) = 1)
           SELECT r.id AS entry_id, min(item) AS q FROM r JOIN k ON k.aux_p = r.aux_p AND k.aux_name = r.aux_name WHERE {_OPEN} GROUP BY 1 HAVING count(DISTINCT item) = 1""")
def crossmatch_aux(t):
    return matchers.by_shared_identifier(t.entry, t.auxiliary)


_BY_IDENTIFIER = f"""SELECT a.entry_id, list_sort(list(DISTINCT k.q)) AS c FROM auxiliary a JOIN entry e ON e.id = a.entry_id JOIN kb_claims k ON k.property = a.aux_p AND k.value = a.aux_name
                     WHERE a.in_wikidata = 0 AND a.aux_p <> 17 AND (e.q IS NULL OR e.uid = 0) GROUP BY 1"""


@query(f"SELECT entry_id, c[1] AS q FROM ({_BY_IDENTIFIER}) x WHERE len(c) = 1")
def auxiliary_match(t):
    return decisions.unique_or_issue(matchers.by_identifier(t.entry, t.auxiliary, t.kb_claims))[0]


@query(f"""SELECT entry_id, 'WD_DUPLICATE' AS type, '["Q' || array_to_string(c, '","Q') || '"]' AS json FROM ({_BY_IDENTIFIER}) x WHERE len(c) > 1""")
def auxiliary_match_issues(t):
    return decisions.unique_or_issue(matchers.by_identifier(t.entry, t.auxiliary, t.kb_claims))[1]


@query("""SELECT e.id AS entry_id, k.q FROM entry e JOIN (SELECT lower(label) AS name, arg_max(q, seq) AS q FROM (SELECT text AS label, q, q * 3 % 101 * 1000 + q AS seq FROM kb_terms) t GROUP BY 1) k
          ON k.name = lower(e.ext_name) WHERE e.q IS NULL""")
def sparql_labels(t):
    labels = t.kb_terms.select(F.col("text").alias("label"), "q", (F.col("q") * 3 % 101 * 1000 + F.col("q")).alias("seq"))
    return matchers.by_terms_ignoring_case(t.entry, labels)


_LIVES = """SELECT CAST(c_custkey % 13 + 1 AS BIGINT) AS q, CAST({p} AS BIGINT) AS property, d.{f} AS value FROM customer JOIN person_dates d ON d.entry_id = c_custkey WHERE d.{f} <> ''"""


def _life_claims(t, field: str, prop: int) -> DataFrame:
    people = t.driver("customer").select(F.col("c_custkey").cast("long").alias("entry_id"), (F.col("c_custkey") % 13 + 1).cast("long").alias("q"))
    return people.join(t.person_dates, "entry_id").where(F.col(field) != "").select("q", F.lit(prop).cast("long").alias("property"), F.col(field).alias("value"))


@query(f"""WITH cl AS ({_LIVES.format(p=569, f='born')}), w AS (SELECT CAST(m.entry_id AS BIGINT) AS entry_id, CAST(x.c AS BIGINT) AS q FROM multi_match m, unnest(string_split(m.candidates, ',')) x(c) UNION SELECT id, q FROM entry WHERE q > 0 AND uid = 0)
           SELECT w.entry_id, array_to_string(list_sort(list(DISTINCT w.q)), ',') AS candidates FROM w JOIN entry e ON e.id = w.entry_id JOIN person_dates d ON d.entry_id = w.entry_id JOIN cl ON cl.q = w.q AND cl.value = d.born
           WHERE (e.q IS NULL OR e.uid = 0) AND length(d.born) = 10 GROUP BY 1""")
def single_date_match(t):
    found = matchers.by_single_date(t.entry, t.person_dates, t.multi_match, _life_claims(t, "born", 569))
    return found.withColumn("candidates", _csv_array("candidates"))


@query(f"""WITH b AS ({_LIVES.format(p=569, f='born')}), d AS ({_LIVES.format(p=570, f='died')}), i AS (SELECT DISTINCT k.text, k.q, substr(b.value, 1, 4) AS yb, substr(d.value, 1, 4) AS yd FROM kb_terms k JOIN b ON b.q = k.q JOIN d ON d.q = k.q),
           n AS (SELECT e.id, CASE WHEN regexp_full_match(e.ext_name, '[^ ]+ .*[^ ]+') THEN regexp_replace(e.ext_name, '^([^ ]+) .*?([^ ]+)$', '\\1 \\2') ELSE e.ext_name END AS text, p.year_born, p.year_died FROM entry e
           JOIN person_dates p ON p.entry_id = e.id WHERE (e.q IS NULL OR e.uid = 0) AND e.type = 'Q5' AND p.born <> '' AND p.died <> '')
           SELECT n.id AS entry_id, array_to_string(list_sort(list(DISTINCT i.q)), ',') AS candidates FROM n JOIN i ON i.text = n.text AND i.yb = n.year_born AND i.yd = n.year_died GROUP BY 1""")
def person_dates_match(t):
    claims = _life_claims(t, "born", 569).unionByName(_life_claims(t, "died", 570))
    return matchers.by_full_dates(t.entry, t.person_dates, t.kb_terms, claims).withColumn("candidates", _csv_array("candidates"))


@query("""SELECT e.id AS entry_id, array_to_string(list_sort(list(DISTINCT k.q)), ',') AS candidates FROM entry e JOIN (SELECT q, CASE q % 2 WHEN 0 THEN 225 ELSE 1420 END AS property, text AS value FROM kb_terms) k
          ON k.value = e.ext_name WHERE (e.q IS NULL OR e.uid = 0) AND e.type = 'Q16521' GROUP BY 1""")
def taxon_match(t):
    claims = t.kb_terms.select("q", F.when(F.col("q") % 2 == 0, 225).otherwise(1420).cast("long").alias("property"), F.col("text").alias("value"))
    return matchers.by_taxon_name(t.entry, claims).withColumn("candidates", _csv_array("candidates"))


@query("""WITH n AS (SELECT id, q, ext_name || ' ' || CAST(id AS VARCHAR) AS name FROM entry), l AS (SELECT id AS q, CASE id % 3 WHEN 0 THEN 'the ' || name WHEN 1 THEN substr(name, 1, length(name) - 1) ELSE name || 's' END AS label FROM n),
          h AS (SELECT DISTINCT l.q, e.id FROM l JOIN n e ON e.q IS NULL AND (contains(lower(l.label), lower(e.name)) OR contains(lower(e.name), lower(l.label))))
          SELECT min(id) AS entry_id, q FROM h GROUP BY q HAVING count(*) = 1""")
def containment_match(t):
    """Names begin with the same few words; a number at the end tells them apart."""
    named = t.entry.withColumn("ext_name", F.concat("ext_name", F.lit(" "), F.col("id").cast("string")))
    label = F.when(F.col("id") % 3 == 0, F.concat(F.lit("the "), "ext_name")).when(F.col("id") % 3 == 1, F.substr("ext_name", F.lit(1), F.length("ext_name") - 1)).otherwise(F.concat("ext_name", F.lit("s")))
    return matchers.by_containment(named, named.select(F.col("id").alias("q"), label.alias("label")))


_WORKS = "SELECT CAST(id + 1000 AS BIGINT) AS q, ext_name AS text, 'Q' || CAST(id % 13 + 1 AS VARCHAR(9)) AS value FROM entry"


@query(f"""WITH w AS ({_WORKS}) SELECT e.id AS entry_id, array_to_string(list_sort(list(DISTINCT w.q)), ',') AS candidates FROM entry e JOIN mnm_relation r ON r.entry_id = e.id AND r.property IN (50, 170)
           JOIN entry c ON c.id = r.target_entry_id AND c.q > 0 AND c.uid > 0 JOIN w ON w.text = e.ext_name AND w.value = 'Q' || CAST(c.q AS VARCHAR) WHERE e.q IS NULL AND e.ext_name LIKE '% %' GROUP BY 1""")
def automatch_creations(t):
    works = t.entry.select((F.col("id") + 1000).alias("q"), F.col("ext_name").alias("text"), F.concat(F.lit("Q"), (F.col("id") % 13 + 1).cast("string")).alias("value"))
    claims = works.select("q", F.lit(170).cast("long").alias("property"), "value")
    return matchers.by_creator(t.entry, t.mnm_relation, claims, works.select("text", "q")).withColumn("candidates", _csv_array("candidates"))


@query("""SELECT e.id AS entry_id, array_to_string(list_sort(list(DISTINCT k.q)), ',') AS candidates FROM entry e JOIN kb_terms k ON regexp_matches(upper(substr(k.text, 1, 1)) || substr(k.text, 2), '^' || upper(substr(e.ext_name, 1, 1)) || '[^ ]* ' || string_split(e.ext_name, ' ')[2] || '$')
          WHERE e.q IS NULL AND e.type = 'Q5' GROUP BY 1""")
def people_with_initials(t):
    short = F.concat(F.upper(F.substring("ext_name", 1, 1)), F.lit(". "), F.element_at(F.split("ext_name", " "), 2))
    terms = t.kb_terms.withColumn("text", F.concat(F.upper(F.substring("text", 1, 1)), F.substring("text", 2, 200)))
    return matchers.by_initials(t.entry.withColumn("ext_name", short), terms).withColumn("candidates", _csv_array("candidates"))


@query("""SELECT a.entry_id, array_to_string(list_sort(list(DISTINCT k.q)), ',') AS candidates FROM auxiliary a JOIN auxiliary b ON b.entry_id = a.entry_id AND b.aux_p = 227 JOIN entry e ON e.id = a.entry_id AND (e.q IS NULL OR e.uid = 0)
          JOIN kb_claims k ON k.property = 214 AND k.value = a.aux_name JOIN kb_claims l ON l.property = 227 AND l.value = b.aux_name AND l.q = k.q WHERE a.aux_p = 214 GROUP BY 1""")
def inventory_match(t):
    """The identifiers 214 and 227 stand in for inventory number and collection."""
    swap = lambda c: F.when(F.col(c) == 214, 217).when(F.col(c) == 227, 195).otherwise(0).cast("long")
    found = matchers.by_inventory_number(t.entry, t.auxiliary.withColumn("aux_p", swap("aux_p")), t.kb_claims.withColumn("property", swap("property")))
    return found.withColumn("candidates", _csv_array("candidates"))


@query("""SELECT entry_id, max(lat) AS lat FROM (SELECT entry_id, lat FROM location WHERE entry_id NOT IN (SELECT id FROM entry WHERE type = 'Q5') UNION ALL SELECT id, 2.0 FROM entry WHERE type = 'Q5') x GROUP BY 1""")
def script_commands(t):
    """Two location commands for every person; the second counts."""
    base = t.entry.where("type = 'Q5'").select(F.col("id").alias("entry_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.lit("setLocation").alias("kind"))
    none = {c: F.lit(None).cast(k) for c, k in (("property", "long"), ("value", "string"), ("language", "string"), ("q", "long"), ("born", "string"), ("died", "string"))}
    rows = base.withColumns({**none, "lat": F.col("seq").cast("double"), "lon": F.lit(0.0)})
    tables = {"auxiliary": t.auxiliary, "location": t.location, "person_dates": t.person_dates, "aliases": t.aliases}
    return commands.write(tables, rows)["location"].select("entry_id", "lat")


@query(f"""SELECT l.entry_id, CAST(round({'2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(k.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(k.lat)) * pow(sin(radians(k.lon - l.lon) / 2), 2), 1.0)))'}) AS BIGINT) AS metres
           FROM location l JOIN entry e ON e.id = l.entry_id AND e.q > 0 JOIN (SELECT CAST(n_nationkey AS BIGINT) AS q, CAST(n_nationkey * 3 - 30 AS DOUBLE) AS lat, CAST(n_nationkey * 11 - 90 AS DOUBLE) AS lon FROM nation) k ON k.q = e.q""")
def quick_compare_distance(t):
    places = t.driver("nation").select(F.col("n_nationkey").cast("long").alias("q"), (F.col("n_nationkey") * 3 - 30).cast("double").alias("lat2"), (F.col("n_nationkey") * 11 - 90).cast("double").alias("lon2"))
    rows = t.location.join(t.entry.where("q > 0").select(F.col("id").alias("entry_id"), "q"), "entry_id").join(places, "q")
    return rows.select("entry_id", F.round(geo.metres(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).cast("long").alias("metres"))


# -- decisions ----------------------------------------------------------------

_DECIDE = "SELECT id AS entry_id, id % 17 + 1 AS q, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 9 END AS uid FROM entry"


def _decide(t) -> DataFrame:
    uid = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 4).otherwise(9).cast("long")
    return t.entry.select(F.col("id").alias("entry_id"), (F.col("id") % 17 + 1).alias("q"), uid.alias("uid"))


@query(f"""WITH d AS ({_DECIDE}), ok AS (SELECT d.* FROM d JOIN entry e ON e.id = d.entry_id WHERE NOT (e.q IS NOT DISTINCT FROM d.q AND e.uid IS NOT DISTINCT FROM d.uid)
           AND (d.uid NOT IN (0, 3, 4, 5) OR e.q IS NULL OR (e.q > 0 AND e.uid = 0)) AND NOT (d.uid = 0 AND EXISTS (SELECT 1 FROM log l WHERE l.entry_id = d.entry_id AND (l.q IS NULL OR l.q = d.q))))
           SELECT e.id, CASE WHEN ok.uid IS NOT NULL THEN ok.q ELSE e.q END AS q, CASE WHEN ok.uid IS NOT NULL THEN ok.uid ELSE e.uid END AS uid, CASE WHEN ok.uid IS NOT NULL THEN '20250101000000' ELSE e.ts END AS ts
           FROM entry e LEFT JOIN ok ON ok.entry_id = e.id""")
def guarded_match_apply(t):
    return decisions.apply_matches(t.entry, _decide(t), t.log, "20250101000000").select("id", "q", "uid", "ts")


@query("SELECT id, CASE WHEN catalog = 3 THEN NULL ELSE q END AS q, CASE WHEN catalog = 3 AND q IS NOT NULL THEN NULL ELSE uid END AS uid FROM entry")
def unmatch_apply(t):
    return decisions.unmatch(t.entry, F.col("catalog") == 3)[0].select("id", "q", "uid")


@query(f"SELECT 'remove_q' AS action, id AS entry_id, uid, q FROM entry WHERE catalog = 3 AND {_FULL}")
def unmatch_log(t):
    return decisions.unmatch(t.entry, F.col("catalog") == 3)[1]


@query("SELECT id, CASE WHEN catalog = 6 AND uid = 0 THEN NULL ELSE q END AS q FROM entry")
def purge_automatches(t):
    return decisions.purge_automatches(t.entry, t.multi_match, 6)[0].select("id", "q")




@query("""SELECT h.id AS entry_id, array_to_string(list(h.q ORDER BY rank, q), ',') AS candidates, CAST(count(*) AS INT) AS candidate_count FROM (SELECT n.id, k.q, min(n.rank) AS rank FROM (SELECT id, ext_name AS text, 0 AS rank
          FROM entry WHERE q IS NULL UNION ALL SELECT e.id, a.label, 1 FROM aliases a JOIN entry e ON e.id = a.entry_id WHERE e.q IS NULL) n JOIN (SELECT DISTINCT text, q FROM kb_terms) k ON k.text = n.text GROUP BY n.id, k.q) h
          GROUP BY h.id HAVING count(*) BETWEEN 2 AND 10""")
def auto_multi_match(t):
    return decisions.first_and_list(matchers.by_search(t.entry, t.aliases, t.kb_terms))[1]


@query("""WITH d AS (SELECT entry_id, aux_p % 3 AS priority, id % 17 + 1 AS q FROM auxiliary) SELECT entry_id, min(q) AS q, min(priority) AS priority FROM d x WHERE priority = (SELECT min(priority) FROM d y WHERE y.entry_id = x.entry_id)
          GROUP BY entry_id""")
def one_decision(t):
    rows = t.auxiliary.select("entry_id", (F.col("aux_p") % 3).alias("priority"), (F.col("id") % 17 + 1).alias("q"))
    return decisions.one_decision(rows)


# -- knowledge base -----------------------------------------------------------


@query(f"""SELECT e.id AS entry_id, CASE WHEN c.wd_prop IS NULL OR c.wd_qual IS NOT NULL THEN 'N/A' WHEN v.n IS NULL THEN 'WD_MISSING' WHEN v.n > 1 AND c.wd_prop IN (214, 227) THEN 'MULTIPLE'
           WHEN list_contains(v.vals, e.ext_id) THEN 'SAME' ELSE 'DIFFERENT' END AS status FROM entry e JOIN catalog c ON c.id = e.catalog AND c.active = 1
           LEFT JOIN (SELECT q, property, count(DISTINCT value) AS n, list(DISTINCT value) AS vals FROM kb_claims GROUP BY 1, 2) v ON v.q = e.q AND v.property = c.wd_prop WHERE e.q > 0 AND e.uid > 0""")
def wd_match_status(t):
    return sync.match_status(t.entry, t.catalog, t.kb_claims)


@query(f"""WITH h AS (SELECT property, value, list(DISTINCT q) AS hs FROM kb_claims GROUP BY 1, 2), r AS (SELECT a.entry_id, e.q, a.aux_p, a.aux_name FROM auxiliary a JOIN entry e ON e.id = a.entry_id WHERE a.in_wikidata = 0
           AND a.aux_p NOT IN (233, 235, 846) AND e.q > 0 AND e.uid > 0 AND NOT (a.aux_p = 17 AND e.type = 'Q5') AND e.q NOT IN ({_META}))
           SELECT * FROM (SELECT r.entry_id, r.q, r.aux_p AS property, r.aux_name AS value, CASE WHEN list_contains(hs, r.q) THEN 'flag' WHEN len(hs) = 1 THEN 'mismatch' WHEN len(hs) > 1 THEN 'multiple'
           WHEN EXISTS (SELECT 1 FROM kb_claims k WHERE k.q = r.q AND k.property = r.aux_p) THEN 'skip' ELSE 'add' END AS action FROM r LEFT JOIN h ON h.property = r.aux_p AND h.value = r.aux_name) x WHERE action <> 'skip'""")
def aux_to_kb_commands(t):
    return sync.aux_commands(t.entry, t.auxiliary, t.kb_claims)


@query(f"""SELECT catalog, q, count(*) AS cnt, {csv()} AS entry_ids, array_to_string(list_sort(list(ext_id)), ',') AS ext_ids FROM entry WHERE {_FULL} GROUP BY 1, 2 HAVING count(*) > 1""")
def microsync_multi_q(t):
    return sync.several_entries(t.entry)


@query(f"SELECT value, count(DISTINCT q) AS cnt, {csv('q')} AS items FROM kb_claims WHERE property = 214 GROUP BY 1 HAVING count(DISTINCT q) > 1")
def microsync_multi_ext(t):
    return sync.several_values(t.kb_claims, 214)


@query(f"""SELECT * FROM (SELECT c.id AS catalog, k.value AS ext_id, k.q AS kb_q, e.id AS entry_id, e.q, CASE WHEN e.id IS NULL THEN 'unknown' WHEN e.q IS NULL OR e.q <= 0 THEN 'adopt' WHEN e.q <> k.q THEN 'differs' ELSE 'same' END AS kind
           FROM kb_claims k JOIN catalog c ON c.wd_prop = k.property AND c.active = 1 AND c.wd_qual IS NULL LEFT JOIN entry e ON e.catalog = c.id AND e.ext_id = k.value) x WHERE kind <> 'same'""")
def microsync_diff(t):
    return sync.differences(t.entry, t.catalog, t.kb_claims)


@query(f"""SELECT coalesce(a.ext_id, b.ext_id) AS ext_id, our_q, kb_q, CASE WHEN our_q IS NULL THEN 'kb_only' WHEN kb_q IS NULL THEN 'local_only' WHEN our_q = kb_q THEN 'same' ELSE 'different' END AS kind
           FROM (SELECT ext_id, min(q) AS our_q FROM entry WHERE catalog = 3 AND {_FULL} AND ext_id NOT LIKE 'fake_id_%' GROUP BY 1) a FULL JOIN (SELECT value AS ext_id, min(q) AS kb_q FROM kb_claims WHERE property = 213 GROUP BY 1) b ON a.ext_id = b.ext_id""")
def get_sync_compare(t):
    return sync.compare(t.entry, t.kb_claims, 3, 213)


@query("SELECT e.id, coalesce(r.to_q, e.q) AS q FROM entry e LEFT JOIN kb_redirects r ON r.from_q = e.q AND r.from_q > 0 AND r.from_q <> r.to_q")
def fix_redirects(t):
    return sync.follow_redirects(t.entry, t.kb_redirects).select("id", "q")


@query("SELECT id, CASE WHEN q > 0 AND q NOT IN (SELECT q FROM kb_items) AND uid = 0 THEN NULL ELSE q END AS q FROM entry")
def unlink_deleted(t):
    return sync.unlink(t.entry, sync.deleted_items(t.entry, t.kb_items)).select("id", "q")


@query(f"SELECT id, CASE WHEN q IN ({_META}) AND uid = 0 THEN NULL ELSE q END AS q FROM entry")
def unlink_meta(t):
    return sync.unlink(t.entry, matchers.meta_items(t.kb_claims)).select("id", "q")


@query("SELECT id AS entry_id, q FROM entry WHERE q > 0 AND type = 'Q5' AND uid IN (3, 4) AND q NOT IN (SELECT q FROM kb_claims WHERE property = 31 AND value = 'Q5')")
def sanity_non_humans(t):
    return sync.non_humans(t.entry, t.kb_claims)


@query(f"""SELECT e.id AS entry_id, k.q FROM entry e JOIN (SELECT value, min(q) AS q FROM kb_claims WHERE property = 215 GROUP BY 1 HAVING count(DISTINCT q) = 1) k ON k.value = e.ext_id WHERE e.catalog = 3 AND (e.q IS NULL OR e.uid = 0)""")
def sync_from_claims(t):
    return sync.adopt_claims(t.entry, t.kb_claims, 3, 215)


_SHIFTED = "SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS catalog, 'P' || CAST(id // 2 AS VARCHAR) AS ext_id, ext_name, ext_desc, q, uid FROM entry"


def _shifted(t) -> DataFrame:
    return t.entry.withColumns({"catalog": F.when(F.col("id") % 2 == 0, 1).otherwise(2).cast("long"), "ext_id": F.concat(F.lit("P"), F.floor(F.col("id") / 2).cast("string"))})


@query(f"""WITH e2 AS ({_SHIFTED}) SELECT b.id AS entry_id, a.q AS new_q, a.uid AS new_uid FROM e2 a JOIN e2 b ON a.ext_id = b.ext_id WHERE a.catalog = 1 AND b.catalog = 2 AND a.q > 0 AND a.uid > 0
           AND (b.q IS NULL OR b.uid = 0) AND (b.q IS NULL OR a.q <> b.q)""")
def mergeable_matches(t):
    return sync.mergeable(_shifted(t), 1, 2)


@query("""SELECT ext_id, ext_name FROM entry WHERE catalog = 1 AND ext_id NOT IN (SELECT ext_id FROM entry WHERE catalog = 2)""")
def copy_missing(t):
    return sync.copy_missing(t.entry, 1, 2).select("ext_id", "ext_name")


@query(f"""WITH e2 AS ({_SHIFTED}) SELECT b.id, CASE WHEN a.q > 0 AND a.uid > 0 AND (b.q IS NULL OR b.uid = 0) AND (b.q IS NULL OR a.q <> b.q) THEN a.q ELSE b.q END AS q
           FROM e2 b LEFT JOIN e2 a ON b.catalog = 2 AND a.catalog = 1 AND a.ext_id = b.ext_id WHERE b.id IS NOT NULL""")
def merge_catalogs(t):
    return sync.merge_catalogs(_shifted(t), 1, 2, "20250101000000").join(t.entry.select("id"), "id", "left_semi").select("id", "q")


@query(f"""WITH u AS (SELECT catalog, {_KEY} AS name, min(id) AS id, min(ext_desc) AS d, min(q) AS q, min(uid) AS uid FROM entry WHERE catalog IN (1, 8) GROUP BY 1, 2 HAVING count(*) = 1)
           SELECT b.id AS entry_id, a.q, CASE WHEN a.d = b.d OR (len(regexp_extract_all(a.d, '[0-9]{{3,4}}')) > 0 AND len(list_filter(regexp_extract_all(a.d, '[0-9]{{3,4}}'), lambda x: NOT contains(b.d, x))) = 0) THEN a.uid ELSE 0 END AS uid
           FROM u a JOIN u b ON a.name = b.name WHERE a.catalog = 1 AND b.catalog = 8 AND a.q > 0 AND a.uid > 0 AND (b.q IS NULL OR b.uid = 0)""")
def migrate_property(t):
    return sync.migrate_property(t.entry, 1, 8)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS q, n_nationkey // 3 AS target FROM nation WHERE n_nationkey > 0), s(q) AS (SELECT 2 UNION SELECT e.q FROM e JOIN s ON e.target = s.q) SELECT CAST(q AS BIGINT) AS q FROM s""")
def class_closure(t):
    edges = t.driver("nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("q"), F.floor(F.col("n_nationkey") / 3).alias("target_q"))
    return sync.closure(edges, t.spark.range(2, 3).withColumnRenamed("id", "q"))


@query("""SELECT l_orderkey AS item, l_partkey % 5 AS main, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS refs FROM lineitem GROUP BY 1, 2""")
def claim_dedup(t):
    rows = t.driver("lineitem").select(F.col("l_orderkey").alias("item"), (F.col("l_partkey") % 5).alias("main"), F.array(F.lit("b"), F.lit("a")).alias("qualifiers"), F.array(F.col("l_suppkey").cast("string")).alias("refs"))
    return sync.merge_claims(rows).select("item", "main", "n", F.array_join("refs", ",").alias("refs"))


# -- maintenance --------------------------------------------------------------


@query(f"SELECT m.entry_id, m.candidates FROM multi_match m WHERE m.entry_id NOT IN (SELECT id FROM entry WHERE {_FULL})")
def drop_candidate_lists(t):
    return maintenance.drop_lists_of_matched(t.multi_match, t.entry).select("entry_id", "candidates")


@query("""WITH f AS (SELECT w.entry_id, CASE WHEN w.catalog = 0 THEN coalesce(e.catalog, 0) ELSE w.catalog END AS catalog, w.status FROM wd_matches w LEFT JOIN entry e ON e.id = w.entry_id)
          SELECT f.entry_id, f.catalog, CASE WHEN c.id IS NOT NULL AND (c.wd_prop IS NULL OR c.wd_qual IS NOT NULL) THEN 'N/A' ELSE f.status END AS status FROM f LEFT JOIN catalog c ON c.id = f.catalog WHERE c.active IS NULL OR c.active = 1""")
def fixup_wd_matches(t):
    return maintenance.fix_statuses(t.wd_matches, t.entry, t.catalog).select("entry_id", "catalog", "status")


@query("""SELECT i.id, CASE WHEN i.status = 'OPEN' AND c.active <> 1 THEN 'INACTIVE_CATALOG' WHEN i.status = 'OPEN' AND i.type = 'MISMATCH_DATES' AND i.json LIKE '%mnm_time%-01-01%' THEN 'JAN01' ELSE i.status END AS status
          FROM issues i LEFT JOIN catalog c ON c.id = i.catalog LEFT JOIN entry e ON e.id = i.entry_id WHERE NOT coalesce(i.status = 'OPEN' AND e.q <= 0 AND e.uid > 0, false)""")
def issues_sweep(t):
    return maintenance.sweep_issues(t.issues, t.entry, t.catalog).select("id", "status")


@query("""WITH x AS (SELECT id, status, type, CAST(regexp_extract(json, 'Q([0-9]+)"', 1) AS VARCHAR) AS a, regexp_extract(json, ',"Q([0-9]+)"', 1) AS b FROM issues),
          y AS (SELECT x.id, x.status, x.type, coalesce(r.to_q, TRY_CAST(x.a AS BIGINT)) AS a, coalesce(s.to_q, TRY_CAST(x.b AS BIGINT)) AS b FROM x LEFT JOIN kb_redirects r ON r.from_q = TRY_CAST(x.a AS BIGINT) LEFT JOIN kb_redirects s ON s.from_q = TRY_CAST(x.b AS BIGINT))
          SELECT id, CASE WHEN status = 'OPEN' AND type = 'WD_DUPLICATE' AND a = b THEN 'DONE' ELSE status END AS status FROM y""")
def duplicate_issues_resolved(t):
    return maintenance.resolve_duplicates(t.issues, t.kb_redirects).select("id", "status")


@query("SELECT id, entry_id, aux_p FROM auxiliary WHERE NOT (aux_p = 17 AND entry_id IN (SELECT id FROM entry WHERE type = 'Q5'))")
def remove_country_of_humans(t):
    return maintenance.drop_country_of_humans(t.auxiliary, t.entry).select("id", "entry_id", "aux_p")


@query("SELECT entry_id, property, target_entry_id FROM mnm_relation WHERE entry_id <> 0 AND target_entry_id <> 0")
def cleanup_relations(t):
    return maintenance.drop_empty_edges(t.mnm_relation)


@query("SELECT id, CASE WHEN q = -1 THEN NULL ELSE q END AS q, CASE WHEN q = -1 THEN NULL ELSE uid END AS uid FROM entry")
def none_to_unmatched(t):
    return maintenance.none_to_unmatched(t.entry).select("id", "q", "uid")


@query("""SELECT 'match_person_dates' AS action, id AS catalog, 'TODO' AS status FROM catalog WHERE active = 1 AND has_person_date NOT IN ('yes', 'no') AND id IN (SELECT e.catalog FROM entry e JOIN person_dates d ON d.entry_id = e.id)
          AND id NOT IN (SELECT catalog FROM jobs WHERE action = 'match_person_dates')""")
def person_date_jobs(t):
    return maintenance.missing_jobs(maintenance.catalogs_with_dates(t.entry, t.person_dates, t.catalog), t.jobs, "match_person_dates")


@query(f"SELECT a.id, CASE WHEN e.{_FULL.replace('uid', 'e.uid')} THEN 1 ELSE 0 END AS entry_is_matched FROM auxiliary a LEFT JOIN entry e ON e.id = a.entry_id")
def propagate_matched(t):
    return maintenance.propagate_matched(t.auxiliary, t.entry, "entry_is_matched").select("id", "entry_is_matched")


@query("SELECT id FROM entry WHERE q IS NOT NULL")
def cascade_delete(t):
    gone = t.entry.where("q IS NULL").select(F.col("id").alias("entry_id"))
    return store.cascade({"entry": t.entry, "auxiliary": t.auxiliary}, gone)["entry"].select("id")


@query("""SELECT entry_id, language, label FROM aliases UNION SELECT id, 'en', ext_name FROM entry e WHERE NOT EXISTS (SELECT 1 FROM aliases a WHERE a.entry_id = e.id AND a.language = 'en' AND a.label = e.ext_name)""")
def add_aliases(t):
    new = t.entry.select(F.col("id").alias("entry_id"), F.lit("en").alias("language"), F.col("ext_name").alias("label"), F.lit(1).alias("added_by_user"))
    return store.insert_ignore(t.aliases, new, ["entry_id", "language", "label"]).select("entry_id", "language", "label").distinct()


@query("""SELECT entry_id, lat, lon FROM location WHERE lat >= 0 UNION ALL SELECT entry_id, lon, lat FROM location WHERE lat < 0""")
def set_locations(t):
    new = t.location.where("lat < 0").select("entry_id", F.col("lon").alias("lat"), F.col("lat").alias("lon"))
    return store.upsert(t.location, new, ["entry_id"])


# -- reports ------------------------------------------------------------------


@query("SELECT type, count(*) AS cnt FROM entry WHERE catalog = 3 GROUP BY type")
def type_counts(t):
    return report.type_counts(t.entry, 3)


@query("SELECT catalog, substr(ts, 1, 6) AS ym, count(*) AS cnt FROM entry WHERE ts IS NOT NULL AND uid <> 0 GROUP BY 1, 2")
def match_by_month(t):
    return report.matches_by_month(t.entry)


@query("SELECT e.catalog, e.uid, u.name AS username, count(*) AS cnt FROM entry e LEFT JOIN users u ON u.id = e.uid WHERE e.uid > 0 GROUP BY 1, 2, 3")
def matcher_by_user(t):
    return report.matches_by_user(t.entry, t.users)


@query(f"SELECT ext_name AS name, count(DISTINCT catalog) AS cnt FROM entry WHERE catalog IN (1, 2, 3, 5, 8, 13) AND {_OPEN} GROUP BY 1 HAVING count(DISTINCT catalog) > 1 ORDER BY cnt DESC, name LIMIT 500")
def top_missing(t):
    return report.top_missing(t.entry, (1, 2, 3, 5, 8, 13))


@query("SELECT ext_name AS name, type, count(*) AS cnt, count(q) AS matched FROM entry GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) < 10 AND count(q) > 0 AND count(q) < count(*)")
def same_names(t):
    return report.same_names(t.entry)


@query("""SELECT e.id, e.ext_name, c.cnt FROM entry e JOIN (SELECT ext_name, count(*) AS cnt FROM entry WHERE q IS NULL GROUP BY 1) c ON c.ext_name = e.ext_name WHERE e.catalog = 7 AND e.type = 'Q5' AND e.q IS NULL AND c.cnt > 1 AND c.cnt < 1000""")
def common_name_counts(t):
    return report.name_counts(t.entry, 7, "Q5")


@query("""SELECT event, entry_id, q, uid, ts, log_id FROM (SELECT 'match' AS event, id AS entry_id, q, uid, ts, CAST(0 AS BIGINT) AS log_id FROM entry WHERE ts >= '20240115000000' AND uid > 0
          UNION ALL SELECT action, entry_id, q, uid, ts, id FROM log WHERE ts >= '20240115000000' AND entry_id IN (SELECT id FROM entry)) x ORDER BY ts DESC, entry_id, event, log_id LIMIT 50 OFFSET 25""")
def recent_changes(t):
    return report.recent_changes(t.entry, t.log, "20240115000000", offset=25)


@query("""SELECT entry_id, q, ts, event FROM (SELECT id AS entry_id, q, ts, 'match' AS event FROM entry WHERE uid = 7 UNION ALL SELECT entry_id, q, ts, action FROM log WHERE uid = 7) x ORDER BY ts DESC, entry_id, event, q NULLS FIRST LIMIT 100""")
def user_edits(t):
    return report.user_edits(t.entry, t.log, 7)


@query("SELECT l.id AS log_id, l.action, l.entry_id, l.uid AS log_uid, l.ts AS log_ts, e.catalog, e.ext_name FROM log l JOIN entry e ON e.id = l.entry_id WHERE l.ts BETWEEN '20240110000000' AND '20240112000000'")
def log_window(t):
    return report.log_window(t.log, t.entry, "20240110000000", "20240112000000")


@query("""WITH r AS (SELECT e.catalog, s.property, s.text, s.entry_id, row_number() OVER (PARTITION BY e.catalog, s.property, s.text ORDER BY s.entry_id, s.id) AS rn FROM statement_text s JOIN entry e ON e.id = s.entry_id WHERE s.q IS NULL)
          SELECT catalog, property, text, count(DISTINCT entry_id) AS cnt, array_to_string(list(entry_id ORDER BY rn) FILTER (rn <= 5), ',') AS samples FROM r GROUP BY 1, 2, 3""")
def statement_text_groups(t):
    return report.statement_groups(t.statement_text, t.entry)


@query("""SELECT r.target_entry_id AS entry_id, count(*) AS cnt FROM mnm_relation r JOIN entry e ON e.id = r.target_entry_id AND e.q IS NULL WHERE r.property = 170 GROUP BY 1 ORDER BY cnt DESC, entry_id LIMIT 25""")
def unmatched_relations(t):
    return report.unmatched_targets(t.mnm_relation, t.entry, 170)


@query("SELECT l.entry_id, l.lat, l.lon, e.ext_name FROM location l JOIN entry e ON e.id = l.entry_id WHERE lat BETWEEN -20 AND 30 AND lon BETWEEN 0 AND 90 ORDER BY l.entry_id LIMIT 5000")
def location_bbox(t):
    return report.in_box(t.location, t.entry, (-20, 30), (0, 90))


_METRES = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"


@query(f"""SELECT a.entry_id AS id, b.entry_id AS other_id, CAST(round({_METRES} / 1000) AS BIGINT) AS km FROM location a, location b WHERE {_METRES} <= 150000""")
def spatial_radius_join(t):
    points = t.location.select(F.col("entry_id").alias("id"), "lat", "lon")
    km = F.round(F.col("metres") / 1000).cast("long").alias("km")
    return geo.within(points, t.location.withColumnRenamed("entry_id", "other_id"), 150_000, measure=km)


@query("""SELECT j.id, j.action, j.catalog FROM jobs j WHERE j.status = 'TODO' AND j.action <> 'microsync' AND (j.depends_on IS NULL OR j.depends_on IN (SELECT id FROM jobs WHERE status = 'DONE'))
          AND j.catalog NOT IN (SELECT id FROM catalog WHERE active <> 1)""")
def jobs_next(t):
    return report.next_jobs(t.jobs, t.catalog, denied=("microsync",)).select("id", "action", "catalog")


@query("SELECT id, CAST(CASE status WHEN 'FAILED' THEN 2 WHEN 'TODO' THEN 3 ELSE 4 END AS BIGINT) AS place FROM jobs")
def job_list(t):
    return report.job_list(t.jobs).select("id", "place")


@query("""SELECT c.id, c.name, coalesce(t.total, 0) AS total FROM catalog c LEFT JOIN (SELECT catalog, count(*) AS total FROM entry GROUP BY 1) t ON t.catalog = c.id WHERE c.active = 1 AND (lower(c.name) LIKE '%a%' OR lower(c.descr) LIKE '%a%')
          ORDER BY total DESC, id LIMIT 20""")
def search_catalogs(t):
    return report.search_catalogs(t.catalog, overview.view(t.entry), "A")


@query(f"SELECT wd_prop, min(id) AS catalog FROM catalog WHERE {_PRIMARY} GROUP BY 1 HAVING count(*) = 1")
def unique_catalog_of_property(t):
    return report.unique_catalog_of_property(t.catalog)


@query(f"SELECT wd_prop, {csv()} AS catalogs FROM catalog WHERE {_PRIMARY} GROUP BY 1")
def property_groups(t):
    return report.catalogs_of_properties(t.catalog)


@query(f"SELECT e.q, c.wd_prop, e.ext_id, min(e.id) AS entry_id FROM entry e JOIN catalog c ON c.id = e.catalog AND c.{_PRIMARY.replace(' AND ', ' AND c.')} WHERE e.q > 0 GROUP BY 1, 2, 3")
def reference_entries(t):
    return report.reference_entry(t.entry, t.catalog)


@query("SELECT status, action, catalog, count(*) AS cnt FROM jobs GROUP BY 1, 2, 3")
def report_matrix(t):
    return t.jobs.groupBy("status", "action", "catalog").agg(F.count("*").alias("cnt"))


@query(f"""SELECT e.id AS entry_id, e.catalog, e.q FROM entry e WHERE {_FULL} AND q NOT IN (SELECT q FROM kb_sitelinks WHERE site = 'enwiki')""")
def missing_pages(t):
    return report.missing_pages(t.entry, t.kb_sitelinks, "enwiki")


@query(f"""SELECT {_KEY} AS name, count(DISTINCT catalog) AS catalogs, count(*) FILTER (q IS NULL) AS unset, {csv()} AS entry_ids FROM entry WHERE {_ACTIVE} AND (q IS NULL OR q <> -1) GROUP BY 1
           HAVING count(DISTINCT catalog) >= 2 AND count(*) FILTER (q IS NULL) >= 2""")
def creation_candidates(t):
    return report.creation_candidates(t.entry, t.catalog)


@query("""SELECT n.name, v.variant FROM (SELECT DISTINCT ext_name || ' x' AS name, string_split(ext_name || ' x', ' ') AS w FROM entry) n, unnest(CASE WHEN len(w) = 3 THEN [name, w[1] || '-' || w[2] || ' ' || w[3], w[1] || ' ' || w[2] || '-' || w[3]] ELSE [name] END) v(variant)""")
def name_variants(t):
    return report.name_variants(t.entry.select(F.concat("ext_name", F.lit(" x")).alias("name")).distinct())


@query("""SELECT e.id AS entry_id, coalesce(a.n, 0) AS n_aliases, coalesce(x.n, 0) AS n_auxiliary, d.born FROM entry e LEFT JOIN (SELECT entry_id, count(DISTINCT (language, label)) AS n FROM aliases GROUP BY 1) a ON a.entry_id = e.id
          LEFT JOIN (SELECT entry_id, count(DISTINCT (aux_p, aux_name)) AS n FROM auxiliary GROUP BY 1) x ON x.entry_id = e.id LEFT JOIN person_dates d ON d.entry_id = e.id""")
def meta_entry_nest(t):
    rows = report.satellites(t.entry, t.aliases, t.descriptions, t.auxiliary, t.person_dates)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return rows.select("entry_id", size("aliases").alias("n_aliases"), size("auxiliary").alias("n_auxiliary"), F.col("person_dates.born").alias("born"))


# -- views --------------------------------------------------------------------

_E = "e.catalog, e.ext_id, e.ext_name, e.type AS entry_type, e.q AS entry_q, e.uid"
_VIEW_SQL = {
    "vw_aliases": f"SELECT a.entry_id, language, label, {_E} FROM aliases a JOIN entry e ON e.id = a.entry_id WHERE e.{_ACTIVE}",
    "vw_dates": f"SELECT d.entry_id, born, died, year_born, year_died, {_E} FROM person_dates d JOIN entry e ON e.id = d.entry_id WHERE e.{_ACTIVE}",
    "vw_aux": f"SELECT a.entry_id, aux_p, aux_name, in_wikidata, {_E} FROM auxiliary a JOIN entry e ON e.id = a.entry_id",
    "vw_location": f"SELECT l.entry_id, lat, lon, {_E} FROM location l JOIN entry e ON e.id = l.entry_id",
    "vw_kv_entry": f"SELECT k.entry_id, kv_key, kv_value, {_E} FROM kv_entry k JOIN entry e ON e.id = k.entry_id",
    "vw_mnm_relation": f"SELECT r.entry_id, property, target_entry_id, {_E} FROM mnm_relation r JOIN entry e ON e.id = r.entry_id",
    "vw_statement_text": f"SELECT s.entry_id, property, text, s.q AS text_q, {_E} FROM statement_text s JOIN entry e ON e.id = s.entry_id",
    "vw_artwork": "SELECT * FROM entry WHERE q IS NULL AND type = 'Q838948' AND id IN (SELECT entry_id FROM mnm_relation WHERE property = 170)",
    "vw_artist_artwork": "SELECT e.id, e.catalog, e.ext_name, w.works, w.first_work, d.year_born, d.year_died FROM entry e JOIN (SELECT target_entry_id, count(*) AS works, min(entry_id) AS first_work FROM mnm_relation WHERE property = 170 GROUP BY 1) w ON w.target_entry_id = e.id LEFT JOIN person_dates d ON d.entry_id = e.id WHERE e.q IS NULL AND e.type = 'Q5'",
    "vw_object_creator": "SELECT o.id AS entry_id, o.catalog, r.property, c.q AS creator_q, o.ext_name || ' ' || c.ext_name AS search FROM mnm_relation r JOIN entry c ON c.id = r.target_entry_id AND c.q > 0 AND c.uid > 0 JOIN entry o ON o.id = r.entry_id AND o.q IS NULL WHERE r.property IN (50, 170)",
    "vw_issues_mismatched_items": f"SELECT i.id AS issue_id, i.entry_id, i.catalog, c.wd_prop, e.ext_id, e.ext_name FROM issues i JOIN catalog c ON c.id = i.catalog AND c.{_PRIMARY.replace(' AND ', ' AND c.')} JOIN entry e ON e.id = i.entry_id WHERE i.status = 'OPEN' AND i.type = 'MISMATCH'",
    "vw_issues_duplicate_items": "SELECT i.id AS issue_id, i.entry_id, i.json, e.catalog, e.ext_id FROM issues i JOIN entry e ON e.id = i.entry_id WHERE i.status = 'OPEN' AND i.type = 'WD_DUPLICATE' AND e.catalog IN (SELECT id FROM catalog WHERE active = 1)",
    "vw_issues_time_mismatch": "SELECT id AS issue_id, entry_id, catalog, json FROM issues WHERE status = 'OPEN' AND type = 'MISMATCH_DATES'",
    "vw_p214": "SELECT entry_id, aux_name AS value FROM auxiliary WHERE aux_p = 214 UNION ALL SELECT id, ext_id FROM entry WHERE catalog IN (SELECT id FROM catalog WHERE wd_prop = 214)",
    "vw_related_catalogs": "SELECT DISTINCT a.catalog, b.catalog AS other FROM mnm_relation r JOIN entry a ON a.id = r.entry_id JOIN entry b ON b.id = r.target_entry_id WHERE a.catalog <> b.catalog",
    "vw_unmatched_creators_with_matched_work": f"SELECT c.id AS entry_id, c.ext_name, {csv('w.q')} AS works FROM mnm_relation r JOIN entry w ON w.id = r.entry_id AND w.q > 0 AND w.uid > 0 JOIN entry c ON c.id = r.target_entry_id AND c.q IS NULL WHERE r.property IN (50, 170) GROUP BY 1, 2",
    "vw_wd_matches": "SELECT status, count(*) AS cnt FROM wd_matches GROUP BY 1",
    "vw_catalogs_with_possible_dates": "SELECT id, name FROM catalog WHERE active = 1 AND has_person_date NOT IN ('yes', 'no') AND id IN (SELECT catalog FROM entry WHERE type = 'Q5' AND ext_desc LIKE '%1%')",
    "vw_catalogs_for_quick_compare": "SELECT id, name FROM catalog WHERE active = 1 AND id IN (SELECT catalog_id FROM kv_catalog WHERE kv_key = 'has_locations' AND kv_value = 'yes')",
    "vw_catalogs2sandra": "SELECT id, name, url, '#/catalog/' || CAST(id AS VARCHAR) AS link FROM catalog WHERE active = 1",
    "vw_potential_missing_wd_catalog_matches": "SELECT c.id AS catalog, lower(regexp_replace(c.name, ' *ID$', '')) AS name, k.q FROM catalog c JOIN (SELECT DISTINCT lower(regexp_replace(text, ' *ID$', '')) AS name, q FROM kb_terms) k ON k.name = lower(regexp_replace(c.name, ' *ID$', ''))",
}
for _name, _sql in _VIEW_SQL.items():
    query(_sql)(getattr(views, _name))


# -- scalar functions ---------------------------------------------------------


@query("""SELECT id, CASE id % 3 WHEN 0 THEN 'Q5' WHEN 1 THEN 'Q5' ELSE '' END AS type, CAST(id AS BIGINT) AS item, id % 3 + 1 AS day, '1' || lpad(CAST(id % 900 AS VARCHAR), 3, '0') AS year FROM entry""")
def scalar_identifiers(t):
    kind = F.when(F.col("id") % 3 == 0, "person").when(F.col("id") % 3 == 1, "q5").otherwise("thing")
    date = F.concat(F.lit("1"), F.lpad((F.col("id") % 900).cast("string"), 3, "0"), F.lit("-02-0"), (F.col("id") % 3 + 1).cast("string"))
    return t.entry.select("id", S.entry_type(kind).alias("type"), text.item_from_uri(F.concat(F.lit("http://kb.example/entity/Q"), F.col("id").cast("string"))).alias("item"),
                          dates.parse(date)["day"].cast("long").alias("day"), dates.year(date).alias("year"))


@query("""SELECT id, string_split(ext_name, ' ')[1] || ' ' || string_split(ext_name, ' ')[len(string_split(ext_name, ' '))] AS simple, ext_name AS sane FROM entry WHERE len(string_split(ext_name, ' ')) > 1""")
def name_normalise(t):
    noisy = F.concat(F.lit("Sir Dr. "), F.col("ext_name"), F.lit(" (d. 1900), Jr."))
    bracketed = F.concat(F.col("ext_name"), F.lit(" (x)"))
    return t.entry.where(F.size(F.split("ext_name", " ")) > 1).select("id", text.simplify_name(noisy).alias("simple"), text.sanitize_name(bracketed).alias("sane"))


@query("""SELECT entry_id, lat, lon, CAST(round(lat * 1000) AS BIGINT) AS metres FROM location""")
def coordinate_parse(t):
    point = geo.parse_point(F.concat(F.lit("POINT("), F.col("lat").cast("string"), F.lit(" "), F.col("lon").cast("string"), F.lit(")")))
    return t.location.select("entry_id", point["lat"].alias("lat"), point["lon"].alias("lon"), F.round(F.when(F.col("lat") < 0, -1).otherwise(1) * geo.parse_distance(F.concat(F.abs("lat").cast("string"), F.lit("km")))).cast("long").alias("metres"))


@query("""SELECT entry_id, born AS canonical, CAST(CASE length(born) WHEN 4 THEN 9 WHEN 7 THEN 10 ELSE 11 END AS INT) AS prec, '+' || substr(born || '-00-00', 1, 4) || CASE length(born) WHEN 4 THEN '-00-00' WHEN 7 THEN substr(born, 5, 3) || '-00' ELSE substr(born, 5, 6) END || 'T00:00:00Z' AS wire,
          died = '' OR (TRY_CAST(year_died AS INT) > CAST(year_born AS INT) AND TRY_CAST(year_died AS INT) - CAST(year_born AS INT) <= 120) AS plausible FROM person_dates""")
def person_date_struct(t):
    born = F.col("born")
    return t.person_dates.select("entry_id", dates.canonical(born).alias("canonical"), dates.precision(born).alias("prec"), dates.wire_time(born).alias("wire"), dates.plausible_life(born, F.col("died")).alias("plausible"))


# -- pages, imports, streams --------------------------------------------------


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs FROM pages")
def page_paragraphs(t):
    return t.driver("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<p[ >])"), 1)).cast("long").alias("paragraphs"))


@query()
def scrape_pages(t):
    """Links of every page as entries: rows only, markup has no SQL form."""
    spec = scraper.Scraper(((r'<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', 2), (r"<p[^>]*>(.*?)</p>", 1)), {"ext_id": scraper.Field("$RID"), "ext_name": scraper.Field("$2"), "ext_url": scraper.Field("$1")})
    return spec.entries(t.driver("pages"))


@query()
def clean_html_pages(t):
    return t.driver("pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


_NEW = "SELECT p_partkey % 4 AS catalog, 'p' || CAST(p_partkey // 4 AS VARCHAR) AS ext_id, p_name AS n, CAST(77 AS BIGINT) AS nq FROM part WHERE p_size <= 25"
_FOUR = "SELECT id, id % 4 AS catalog, 'P' || CAST(id // 4 AS VARCHAR) AS ext_id, ext_name, q, uid FROM entry"


@query(f"""WITH n AS ({_NEW}), o AS ({_FOUR}) SELECT o.catalog, o.ext_id, CASE WHEN n.nq IS NOT NULL THEN n.n || '!' ELSE o.ext_name END AS ext_name, CASE WHEN n.nq IS NOT NULL AND NOT coalesce(o.uid > 0, false) THEN n.nq ELSE o.q END AS q
           FROM o LEFT JOIN n ON n.catalog = o.catalog AND lower(n.ext_id) = lower(o.ext_id) WHERE n.nq IS NOT NULL OR coalesce(o.uid > 0, false)""")
def import_delete_absent(t):
    id_ = F.col("p_partkey")
    new = t.driver("part").where("p_size <= 25").select(
        (id_ % 4).cast("long").alias("catalog"), F.concat(F.lit("p"), F.floor(id_ / 4).cast("string")).alias("ext_id"), F.lit("").alias("ext_url"), F.concat("p_name", F.lit("!")).alias("ext_name"),
        F.lit("").alias("ext_desc"), F.lit(77).cast("long").alias("q"), F.lit(0).cast("long").alias("uid"), F.lit("20250101000000").alias("ts"), F.lit("").alias("type"),
    )
    old = t.entry.withColumns({"catalog": F.col("id") % 4, "ext_id": F.concat(F.lit("P"), F.floor(F.col("id") / 4).cast("string"))})
    return meta_entry.import_entries(old, new, "add_replace_delete").select("catalog", "ext_id", "ext_name", "q")


@query(f"""WITH v AS (SELECT property, value, min(q) AS q FROM kb_claims WHERE (property, value) IN (SELECT (property, value) FROM kb_claims WHERE property >= 214) GROUP BY 1, 2 HAVING count(DISTINCT q) = 1)
           SELECT e.id AS entry_id, v.q FROM entry e JOIN catalog c ON c.id = e.catalog AND c.{_PRIMARY.replace(' AND ', ' AND c.')} JOIN v ON v.property = c.wd_prop AND v.value = e.ext_id WHERE e.q IS NULL OR e.uid = 0""")
def change_feed_matches(t):
    changes = t.kb_claims.where("property >= 214").select(F.col("q").alias("item"), "property").distinct()
    return feeds.changes_to_matches(changes, t.kb_claims, t.entry, t.catalog)


@query(f"""SELECT catalog, CAST(sum(n) AS BIGINT) AS total, {', '.join(f"CAST(sum(CASE WHEN b = '{b}' THEN n ELSE 0 END) AS BIGINT) AS {b}" for b in S.BUCKETS)} FROM (SELECT catalog, {_CLASS} AS b, 1 AS n FROM entry) x GROUP BY catalog""")
def overview_stream(t):
    """Running counts from a feed of +1 changes, run to its end as a stream."""
    import uuid

    from lodestone.plans.lineage import shared_dir

    base = f"{shared_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    t.entry.select("catalog", S.bucket().alias("bucket"), F.lit(1).alias("n")).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema("catalog long, bucket string, n int").parquet(f"{base}/in")
    run = feeds.run_batches(stream, lambda batch: feeds.running_overview(batch), f"{base}/out", f"{base}/checkpoint")
    run.awaitTermination()
    parts = t.spark.read.parquet(f"{base}/out").drop("batch")
    return parts.groupBy("catalog").agg(*[F.sum(c).alias(c) for c in ("total", *S.BUCKETS)])


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(t):
    return feeds.windowed(t.driver("events"))


@query("SELECT catalog, type, count(*) AS cnt, GROUPING(type) AS g FROM entry GROUP BY ROLLUP (catalog, type) HAVING GROUPING(catalog) = 0")
def rollup_types(t):
    """An extension: subtotals by catalog and type."""
    rows = t.entry.rollup("catalog", "type").agg(F.count("*").alias("cnt"), F.grouping("type").cast("long").alias("g"), F.grouping("catalog").alias("gc"))
    return rows.where("gc = 0").drop("gc")


from lodestone import queries_control, queries_io, queries_match  # noqa: E402, F401  they add theirs
