"""Queries of sources, sinks and feeds: what is written is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import dates, text
from lodestone.operators import control, report, sync
from lodestone.plans.entry_query import Download
from lodestone.plans.lineage import shared_dir
from lodestone.registry import FULL, query
from lodestone.sinks import text as sinks
from lodestone.sources import feed_rows, meta_entry, scraper, tabular
from lodestone.streaming import feeds


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


# -- delimited files ----------------------------------------------------------

_SOURCE = tabular.TabularSource(
    9, ("id", "name", "desc", "q", "type", "born", "P214", "Aen"), skip_rows=1, url_pattern="http://x/$1", patterns=(("died", 2, r"Brand#(\d\d)"),)
)


def _file(t) -> str:
    """Parts as delimited files with a header in each."""
    path = _folder(t)
    k = F.col("p_partkey")
    rows = t.driver("part").select(
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" "), "p_brand").alias("desc"),
        F.when(k % 3 == 0, F.concat(F.lit("Q"), (k % 50 + 1).cast("string"))).otherwise("").alias("q"), F.when(k % 2 == 0, "person").otherwise("q16521").alias("type"),
        F.when(k % 4 == 0, "1900-3-7").when(k % 4 == 1, "about 1900").otherwise("").alias("born"), F.concat(k.cast("string"), F.lit("|y"), k.cast("string"), F.lit("| ")).alias("aux"), F.lit("also").alias("alias"),
    )
    rows.repartition(3).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return path


@query("""SELECT 'x' || CAST(p_partkey AS VARCHAR) AS ext_id, p_name AS ext_name, 'http://x/x' || CAST(p_partkey AS VARCHAR) AS ext_url, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 + 1 END AS q, CASE WHEN p_partkey % 3 = 0 THEN 4 END AS uid,
          CASE p_partkey % 2 WHEN 0 THEN 'Q5' ELSE 'Q16521' END AS type, CASE p_partkey % 4 WHEN 0 THEN '1900-03-07' END AS born FROM part WHERE p_partkey % 10 <> 0""")
def tabular_entries(t):
    found = _SOURCE.entries(_SOURCE.read(t.spark, _file(t)))
    return found.select("ext_id", "ext_name", "ext_url", "q", "uid", "type", "born")


@query("SELECT 'x' || CAST(p_partkey AS VARCHAR) AS ext_id, 214 AS prop_numeric, v.value FROM part, unnest([CAST(p_partkey AS VARCHAR), 'y' || CAST(p_partkey AS VARCHAR)]) v(value) WHERE p_partkey % 10 <> 0")
def tabular_identifiers(t):
    found = _SOURCE.entries(_SOURCE.read(t.spark, _file(t)))
    return found.select("ext_id", F.explode("auxiliary").alias("x")).select("ext_id", "x.prop_numeric", "x.value")


@query("SELECT count(*) AS total, count(*) FILTER (p_partkey % 10 <> 0) AS with_id, CAST(0 AS BIGINT) AS errors FROM part")
def tabular_counts(t):
    return _SOURCE.counts(_SOURCE.read(t.spark, _file(t)))


@query("SELECT 0 AS nth, 'id,name,desc,q,type,born,aux,alias' AS cells")
def tabular_preview(t):
    """The header line; which rows follow it is up to the files."""
    found = tabular.preview(t.spark, _file(t), "TSV", 4)
    return found.where("nth = 0").select("nth", F.array_join("cells", ",").alias("cells"))


@query("SELECT e.id, e.ext_name || CASE e.id % 3 WHEN 0 THEN '' ELSE ' 2' END AS ext_name, e.ext_desc, coalesce(e.q, CASE e.id % 3 WHEN 0 THEN NULL ELSE 77 END) AS q FROM entry e WHERE e.catalog = 3")
def import_merge(t):
    """The merging mode: fields that aren't empty, an item only where there is none."""
    own = t.entry.where("catalog = 3")
    name = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat("ext_name", F.lit(" 2")))
    new = own.select("catalog", "ext_id", name.alias("ext_name"), F.lit("").alias("ext_desc"), F.lit(None).cast("string").alias("ext_url"), F.lit("").alias("type"), F.when(F.col("id") % 3 != 0, 77).cast("long").alias("q"), F.lit(9).cast("long").alias("uid"))
    return meta_entry.merge_fields(own, new).select("id", "ext_name", "ext_desc", "q")


@query("SELECT catalog, ext_id, ext_name FROM entry UNION ALL SELECT 3, 'n' || CAST(n_nationkey AS VARCHAR), n_name FROM nation")
def import_add(t):
    """The adding mode: what is there stays."""
    none = {c: F.lit(None).cast(k) for c, k in (("q", "long"), ("uid", "long"), ("ts", "string"))}
    new = t.driver("nation").select(F.lit(3).cast("long").alias("catalog"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("ext_id"), F.col("n_name").alias("ext_name"))
    both = new.unionByName(t.entry.where("catalog = 3").select("catalog", F.lower("ext_id").alias("ext_id"), F.lit("other").alias("ext_name")))
    blank = both.withColumns({"ext_url": F.lit(""), "ext_desc": F.lit(""), "type": F.lit(""), **none})
    return meta_entry.import_entries(t.entry, blank, "add").select("catalog", "ext_id", "ext_name")


# -- nested entries -----------------------------------------------------------


def _nested(t):
    """Entries of two catalogs with their satellites as JSON lines, read and flattened."""
    rows = report.satellites(t.entry.where("catalog IN (1, 2)"), t.aliases, t.descriptions, t.auxiliary, t.person_dates).join(t.location, "entry_id", "left")
    rows = rows.select(
        F.struct("catalog", "ext_id", "ext_url", "ext_name", "ext_desc", "q", F.col("uid").alias("user"), F.col("ts").alias("timestamp"), "type").alias("entry"),
        "auxiliary", "person_dates", "descriptions", "aliases", F.when(F.col("lat").isNotNull(), F.struct("lat", "lon")).alias("coordinate"),
    )
    path = _folder(t)
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return meta_entry.flatten(meta_entry.read(t.spark, path))


@query("SELECT catalog, ext_id, ext_name, q, type FROM entry WHERE catalog IN (1, 2)")
def nested_entries(t):
    return _nested(t)["entry"].select("catalog", "ext_id", "ext_name", "q", "type")


@query("SELECT DISTINCT e.catalog, e.ext_id, a.aux_p, a.aux_name FROM auxiliary a JOIN entry e ON e.id = a.entry_id AND e.catalog IN (1, 2)")
def nested_identifiers(t):
    return _nested(t)["auxiliary"].select("catalog", "ext_id", "aux_p", "aux_name")


@query("""SELECT e.ext_id, 'd' AS kind, d.born AS value FROM person_dates d JOIN entry e ON e.id = d.entry_id AND e.catalog IN (1, 2) UNION ALL SELECT e.ext_id, 'l', CAST(CAST(l.lat AS BIGINT) AS VARCHAR) FROM location l JOIN entry e ON e.id = l.entry_id AND e.catalog IN (1, 2)
          UNION ALL SELECT e.ext_id, 'a', x.label FROM (SELECT DISTINCT entry_id, language, label FROM aliases) x JOIN entry e ON e.id = x.entry_id AND e.catalog IN (1, 2) UNION ALL SELECT e.ext_id, 't', x.label FROM descriptions x JOIN entry e ON e.id = x.entry_id AND e.catalog IN (1, 2)""")
def nested_satellites(t):
    flat = _nested(t)
    of = lambda name, kind, value: flat[name].select("ext_id", F.lit(kind).alias("kind"), value.alias("value"))
    rows = of("person_dates", "d", F.col("born")).unionByName(of("location", "l", F.col("lat").cast("long").cast("string")))
    return rows.unionByName(of("aliases", "a", F.col("label"))).unionByName(of("descriptions", "t", F.col("label")))


# -- answers, pages -----------------------------------------------------------


@query("SELECT DISTINCT q, text AS label FROM kb_terms")
def sparql_rows(t):
    """Terms as lines of a TSV answer."""
    line = F.concat(F.lit("<http://kb.example/entity/Q"), F.col("q").cast("string"), F.lit('>\t"'), F.col("text"), F.lit('"@en'))
    rows = scraper.sparql_tsv(t.kb_terms.select(line.alias("value")), ["uri", "label"])
    return rows.select(text.item_from_uri(F.col("uri")).alias("q"), "label").distinct()


@query("SELECT text AS label, max(q) AS q FROM kb_terms GROUP BY 1")
def sparql_label_items(t):
    """Terms as one JSON answer for each text, the URI first or second; the last item counts."""
    cell = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    pair = lambda x, name: F.create_map(F.lit("q"), cell("uri", F.concat(F.lit("http://kb.example/entity/Q"), x.cast("string"))), F.lit("l"), cell("literal", name))
    rows = t.kb_terms.groupBy("text").agg(F.array_sort(F.collect_set("q")).alias("qs"))
    bindings = F.transform("qs", lambda x: pair(x, F.col("text")))
    head = F.when(F.length("text") % 2 == 0, F.array(F.lit("q"), F.lit("l"))).otherwise(F.array(F.lit("l"), F.lit("q")))
    answers = rows.select(F.to_json(F.struct(F.struct(head.alias("vars")).alias("head"), F.struct(bindings.alias("bindings")).alias("results"))).alias("value"))
    return scraper.label_items(answers)


@query("SELECT page_id, CAST(1 AS BIGINT) AS blocks, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS rx1 FROM pages")
def scrape_analysis(t):
    spec = scraper.Scraper(((r"(<p[ >])", 1),), {"ext_id": scraper.Field("$1")})
    return spec.analysis(t.driver("pages").select("page_id", "html"))


@query("SELECT CAST(a.n AS VARCHAR) AS l1, CAST(k.k AS VARCHAR) AS l2, 'http://s/' || CAST(a.n AS VARCHAR) || '/' || CAST(k.k AS VARCHAR) AS url FROM generate_series(1, 9, 2) a(n), generate_series(1, 3) k(k)")
def scrape_urls(t):
    """A range and the keys that an outer key's page gives."""
    outer = scraper.range_level(t.spark, 1, 9, 2, "l1")
    pages = outer.select("l1", F.concat(F.lit("http://list/"), "l1").alias("url"), F.lit("<a k=1><a k=2><a k=3><a k=2>").alias("html"))
    both = scraper.follow_level(pages, "http://list/$1", r"<a k=(\d)>", "l2")
    return both.select("l1", "l2", F.concat(F.lit("http://s/"), "l1", F.lit("/"), "l2").alias("url"))


@query("SELECT DISTINCT replace(n_name, ' ', '_') AS l1 FROM nation")
def scrape_wiki_titles(t):
    member = F.struct(F.col("n_name").alias("title"))
    answers = t.driver("nation").groupBy("n_regionkey").agg(F.collect_list(member).alias("m")).select(F.to_json(F.struct(F.struct(F.col("m").alias("categorymembers")).alias("query"))).alias("value"))
    return scraper.wiki_level(answers, "l1")


@query("SELECT id, 'https://x/' || CAST(id AS VARCHAR) || '%20' AS url, CASE id % 2 WHEN 0 THEN '00' || CAST(id AS VARCHAR) ELSE '0 0' || CAST(id AS VARCHAR) END AS fixed FROM entry")
def scalar_urls(t):
    key = F.col("id").cast("string")
    url = text.url_from_pattern(F.when(F.col("id") % 2 == 0, "").otherwise(text.safe_url(F.concat(F.lit("https://x/"), key, F.lit(" ")))), F.lit("https://x/$1%20"), key)
    prop = F.when(F.col("id") % 2 == 0, 213).otherwise(214)
    return t.entry.select("id", url.alias("url"), text.fix_external_id(prop, F.concat(F.lit("0 0"), key)).alias("fixed"))


@query("SELECT id, CAST(id AS VARCHAR) AS found FROM entry")
def scalar_formatter(t):
    """A URL pattern as a regex finds the identifier again, with either protocol."""
    url = F.concat(F.when(F.col("id") % 2 == 0, "http").otherwise("https"), F.lit("://x.org/a?id="), F.col("id").cast("string"))
    rows = t.entry.select("id", url.alias("url"), text.formatter_to_regex(F.lit("http://x.org/a?id=$1")).alias("rx"))
    return rows.select("id", F.get(F.regexp_extract_all(F.col("url"), F.col("rx"), 1), F.lit(0)).alias("found"))


@query("SELECT id, '19' || lpad(CAST(id % 90 + 10 AS VARCHAR), 2, '0') || CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '-03-07' WHEN 2 THEN '-03' ELSE '-08-15' END AS date FROM entry")
def scalar_dates(t):
    year = F.concat(F.lit("19"), F.lpad((F.col("id") % 90 + 10).cast("string"), 2, "0"))
    said = F.when(F.col("id") % 4 == 0, year).when(F.col("id") % 4 == 1, F.concat(F.lit("7. 3. "), year)).when(F.col("id") % 4 == 2, F.concat(F.lit("März "), year)).otherwise(F.concat(F.lit("15 août "), year))
    return t.entry.select("id", dates.parse_text(said).alias("date"))


@query("SELECT id, CAST(id % 12 + 1 AS BIGINT) AS number, ['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'][id % 12 + 1] AS code FROM entry")
def scalar_months(t):
    names = F.array(*[F.lit(x) for x in "Januar février marzo Avril mayo Juni luglio agosto September Oktober novembre dic".split()])
    name = F.get(names, (F.col("id") % 12).cast("int"))
    return t.entry.select("id", dates.month_number(name).cast("long").alias("number"), dates.month_code(name).alias("code"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN '1990' WHEN 1 THEN '1990-05' WHEN 2 THEN '1990-05-24' END AS date, CASE WHEN id % 4 <> 3 THEN id % 4 + 9 END AS prec, '2024-01-0' || CAST(id % 9 + 1 AS VARCHAR) || 'T12:00:00+00:00' AS stamp,
          CASE id % 3 WHEN 0 THEN NULL ELSE least(100.0, (id % 7) * 50.0 / (id % 3)) END AS percent FROM entry""")
def scalar_wire(t):
    wire = F.concat(F.lit("+1990-05-24T00:00:00Z/"), F.when(F.col("id") % 4 == 3, "99").otherwise((F.col("id") % 4 + 9).cast("string")))
    stamp = F.concat(F.lit("2024010"), (F.col("id") % 9 + 1).cast("string"), F.lit("120000"))
    done = text.percent((F.col("id") % 7) * 0.5, F.col("id") % 3)
    return t.entry.select("id", dates.from_wire(wire).alias("date"), dates.parse_wire(wire)["precision"].cast("long").alias("prec"), dates.stamp(stamp).alias("stamp"), done.alias("percent"))


@query("""SELECT id, CASE id % 3 WHEN 0 THEN ext_desc WHEN 1 THEN 'a ; b; ' || ext_desc ELSE 'a' END AS desc_, '[http://f/' || ext_id || ' ' || ext_id || ']' AS link, CASE ext_url WHEN '' THEN ext_id ELSE '[' || ext_url || ' ' || ext_id || ']' END AS own,
          chr(39) || 'it' || chr(39) || chr(39) || 's ' || ext_id || chr(39) AS quoted FROM entry""")
def scalar_texts(t):
    parts = F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).when(F.col("id") % 3 == 1, F.array(F.lit("<b>a</b>"), F.lit(" b"))).otherwise(F.array(F.lit("a")))
    old = F.when(F.col("id") % 3 == 2, "a").otherwise(F.col("ext_desc"))
    links = text.wiki_link(F.col("ext_id"), F.col("ext_url"), "http://f/$1").alias("link"), text.wiki_link(F.col("ext_id"), F.col("ext_url")).alias("own")
    return t.entry.select("id", text.new_description(old, parts).alias("desc_"), *links, text.quoted(F.concat(F.lit("it's "), "ext_id")).alias("quoted"))


# -- downloads, feeds, reports ------------------------------------------------


@query(f"""SELECT '#q' || chr(9) || 'ext_id' || chr(9) || 'ext_url' || chr(9) || 'ext_name' || chr(9) || 'username' AS value UNION ALL SELECT CAST(e.q AS VARCHAR) || chr(9) || e.ext_id || chr(9) || e.ext_url || chr(9) || e.ext_name || chr(9) || coalesce(u.name, '')
           FROM entry e LEFT JOIN users u ON u.id = e.uid WHERE e.{FULL.replace('uid', 'e.uid')} AND e.catalog = 5""")
def download_tsv(t):
    """Written as text and read back."""
    path = _folder(t)
    sinks.write(sinks.tsv(report.matched_download(t.entry, t.users, 5)), path)
    return t.spark.read.text(path)


@query("""SELECT '{"entry_id":' || CAST(e.id AS VARCHAR) || ',"catalog":' || CAST(e.catalog AS VARCHAR) || ',"external_id":"' || e.ext_id || '","q":' || coalesce(CAST(e.q AS VARCHAR), 'null') || ',"name":"' || e.ext_name || '","entry_type":"' || e.type || '","born":' || coalesce('"' || d.born || '"', 'null') || ',"died":' || coalesce('"' || d.died || '"', 'null') || '}' AS value
          FROM entry e LEFT JOIN person_dates d ON d.entry_id = e.id WHERE e.catalog = 5""")
def download_json(t):
    return sinks.json_rows(Download((5,), dates=True).run(t.entry, t.users, t.person_dates, t.location, t.multi_match))


@query("""SELECT CASE event WHEN 'remove_q' THEN 'Match was removed for "' ELSE 'New match for "' END || ext_name || '"' AS title, substr(ts, 1, 4) || '-' || substr(ts, 5, 2) || '-' || substr(ts, 7, 2) || 'T' || substr(ts, 9, 2) || ':' || substr(ts, 11, 2) || ':' || substr(ts, 13, 2) || '+00:00' AS updated,
          'http://x/#/entry/' || CAST(entry_id AS VARCHAR) AS link FROM (SELECT 'match' AS event, id AS entry_id, ext_name, ts, CAST(0 AS BIGINT) AS log_id FROM entry WHERE ts >= '20240115000000' AND uid > 0
          UNION ALL SELECT l.action, l.entry_id, e.ext_name, l.ts, l.id FROM log l JOIN entry e ON e.id = l.entry_id WHERE l.ts >= '20240115000000') x ORDER BY ts DESC, entry_id, event, log_id LIMIT 50""")
def feed_of_changes(t):
    return sinks.changes_feed(report.recent_changes(t.entry, t.log, "20240115000000"), t.entry, "http://x/")


@query("SELECT 'New catalog: ' || c.name AS title, 'http://x/#/catalog/' || CAST(c.id AS VARCHAR) AS link FROM catalog c JOIN kv_catalog k ON k.catalog_id = c.id AND k.kv_key = 'created_at' WHERE c.active = 1")
def feed_of_catalogs(t):
    return sinks.catalogs_feed(control.newest_catalogs(t.catalog, t.kv_catalog), "http://x/").select("title", "link")


_SECTION = """SELECT {k} AS section, 0 AS part, '' AS key, '== {head} ==' AS value FROM n{k} WHERE n > 0 UNION ALL SELECT {k}, 1, '', '! id' FROM n{k} WHERE n BETWEEN 1 AND 400 UNION ALL SELECT {k}, 3, '', '|}}' FROM n{k} WHERE n BETWEEN 1 AND 400
              UNION ALL SELECT {k}, 2, '', '* ' || CAST(n AS VARCHAR) || ' rows. Too many to show individually.' FROM n{k} WHERE n > 400 UNION ALL SELECT {k}, 2, key, value FROM s{k}, n{k} WHERE n <= 400"""


@query(f"""WITH d AS (SELECT c.id AS catalog, k.value AS ext_id, k.q AS kb_q, e.id AS entry_id, e.q FROM kb_claims k JOIN catalog c ON c.wd_prop = k.property AND c.active = 1 AND c.wd_qual IS NULL LEFT JOIN entry e ON e.catalog = c.id AND e.ext_id = k.value),
           s0 AS (SELECT ext_id AS key, '| [http://f/' || ext_id || ' ' || ext_id || '] || ' || chr(123) || chr(123) || 'Q|' || CAST(kb_q AS VARCHAR) || chr(125) || chr(125) AS value FROM d WHERE entry_id IS NULL AND catalog = 3),
           s1 AS (SELECT ext_id AS key, '| ' || ext_id || ' || ' || chr(123) || chr(123) || 'Q|' || CAST(kb_q AS VARCHAR) || chr(125) || chr(125) || ' || ' || chr(123) || chr(123) || 'Q|' || CAST(q AS VARCHAR) || chr(125) || chr(125) AS value FROM d WHERE q > 0 AND q <> kb_q),
           n0 AS (SELECT count(*) AS n FROM s0), n1 AS (SELECT count(*) AS n FROM s1) {_SECTION.format(k=0, head="Unknown")} UNION ALL {_SECTION.format(k=1, head="Different")}""")
def wiki_report(t):
    found = sync.differences(t.entry, t.catalog, t.kb_claims)
    return sinks.wiki_report({"Unknown": (sinks.unknown_ids(found.where("catalog = 3"), "http://f/$1"), "! id"), "Different": (sinks.differing(found), "! id")})


# -- external feeds -----------------------------------------------------------


def _feed(t):
    k = F.col("s_suppkey")
    fields = {
        "source_id": F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("P"), (k * 25 + 3).cast("string"))), "label": F.when(k % 2 == 0, F.col("s_name")), "original_label": F.when(k % 5 != 0, F.concat(F.lit("o "), "s_name")),
        "description": F.when(k % 3 == 0, "d"), "q": F.when(k % 4 == 0, (k % 9 + 1).cast("string")), "p31": F.when(k % 2 == 0, 5), "p569": F.concat(F.lit("+1990-05-24T00:00:00Z/"), (k % 4 + 9).cast("string")), "revision": k,
    }
    lines = t.driver("supplier").select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))
    return feed_rows.parse(lines.unionByName(t.spark.createDataFrame([("{bad",), ("",)], "value string")))


_FEED = """SELECT 'P' || CAST(s_suppkey * 25 + 3 AS VARCHAR) AS ext_id, CASE s_suppkey % 2 WHEN 0 THEN s_name ELSE 'o ' || s_name END AS ext_name, CASE s_suppkey % 2 WHEN 0 THEN 'Q5' ELSE '' END AS type, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 9 + 1 END AS q,
           CASE s_suppkey % 4 WHEN 0 THEN '1990' WHEN 1 THEN '1990-05' WHEN 2 THEN '1990-05-24' END AS born FROM supplier WHERE s_suppkey % 9 <> 0 AND NOT (s_suppkey % 2 = 1 AND s_suppkey % 5 = 0) AND s_suppkey >= 3"""


@query(_FEED)
def feed_entries(t):
    """A feed's rows from a revision on, bad lines left out."""
    return feed_rows.entries(_feed(t), 3, revision=3).select("ext_id", "ext_name", "type", "q", "born")


@query(f"""WITH f AS ({_FEED}) SELECT e.catalog, e.ext_id, coalesce(f.ext_name, e.ext_name) AS ext_name, e.q FROM entry e LEFT JOIN f ON e.catalog = 3 AND f.ext_id = e.ext_id UNION ALL SELECT 3, f.ext_id, f.ext_name, f.q FROM f WHERE f.ext_id NOT IN (SELECT ext_id FROM entry WHERE catalog = 3)""")
def feed_applied(t):
    return feed_rows.apply(t.entry, feed_rows.entries(_feed(t), 3, revision=3))[0].select("catalog", "ext_id", "ext_name", "q")


@query("SELECT DISTINCT a.id AS entry_id, 50 AS property, b.id AS target_entry_id FROM entry a JOIN entry b ON b.catalog = 4 AND b.id = a.id + 1 WHERE a.catalog = 3")
def feed_edges(t):
    rows = t.entry.where("catalog IN (2, 3)").select(F.col("ext_id").alias("e1_source_id"), F.lit(50).cast("long").alias("property"), F.lit(12).cast("long").alias("e2_scraper_id"), F.concat(F.lit("P"), (F.col("id") + 1).cast("string")).alias("e2_source_id"))
    return feed_rows.edges(rows, t.entry, t.feed_sources, 3)


@query("SELECT l.id FROM log l WHERE l.ts >= (SELECT kv_value FROM kv WHERE kv_key = 'feed_asia') UNION ALL SELECT -id FROM log WHERE ts >= '20240101060000'")
def feed_since(t):
    """Changes from the stored mark on, the mark's own included, and without a mark from a start."""
    found = feeds.since(t.log, t.kv, "feed_asia", "0").select("id")
    return found.unionByName(feeds.since(t.log, t.kv, "feed_none", "20240101060000").select((-F.col("id")).alias("id")))


@query("SELECT kv_key, CASE kv_key WHEN 'feed_asia' THEN (SELECT max(ts) FROM log) ELSE kv_value END AS kv_value FROM kv")
def feed_advanced(t):
    """The mark moves to the last change; a feed without changes leaves it."""
    once = feeds.advanced(t.kv, t.log, "feed_asia")
    return feeds.advanced(once, t.log.where("false"), "feed_europe")


_GONE = "q IN (3, 9, 10) AND q NOT IN (SELECT q FROM kb_items) AND (uid IS NULL OR uid = 0)"


@query(f"SELECT id, CASE WHEN {_GONE} THEN NULL ELSE q END AS q FROM entry")
def feed_deletions(t):
    """Items that a feed calls deleted, of which some are still there."""
    said = t.spark.createDataFrame([(3,), (9,), (10,)], "q long")
    return feeds.deletions(t.entry, said, t.kb_items)[0].select("id", "q")


@query(f"SELECT DISTINCT catalog FROM entry WHERE {_GONE}")
def feed_deletions_touched(t):
    said = t.spark.createDataFrame([(3,), (9,), (10,)], "q long")
    return feeds.deletions(t.entry, said, t.kb_items)[1]


@query("SELECT from_q, to_q FROM kb_redirects WHERE from_q > 0 AND to_q > 0 AND from_q <> to_q")
def feed_redirects(t):
    more = t.kb_redirects.select(F.col("from_q"), F.col("from_q").alias("to_q"))
    return feeds.redirects_of(t.kb_redirects.unionByName(more).unionByName(t.kb_redirects))


@query("SELECT l.id AS item FROM log l WHERE l.id % 3 <> 0")
def feed_lines(t):
    """JSON lines of which a third can't be read."""
    lines = t.log.select(F.when(F.col("id") % 3 == 0, "{no").otherwise(F.to_json(F.struct(F.col("id").alias("item")))).alias("value"))
    return feeds.parse_lines(lines, "item long")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def feed_stream_once_each(t):
    """A true stream that repeats every event: each counts once."""
    base = _folder(t)
    events = t.driver("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.unionByName(events).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(events.schema).parquet(f"{base}/in")
    kept = feeds.once_each(stream, ["event_id"], "400 days")
    run = kept.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(events.schema).parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_stream(t):
    """Windows over a true stream with a watermark, each micro-batch's changes applied in turn."""
    base = _folder(t)
    events = t.driver("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{base}/in")
    stream = feeds.windowed(t.spark.readStream.schema(events.schema).parquet(f"{base}/in"), late="400 days")

    def write(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    changed = t.spark.read.parquet(f"{base}/out")
    return changed.groupBy("window_start", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (q IS NULL) AS noq, count(*) FILTER (uid = 0) AS autoq, count(*) FILTER (q = 0) AS na, count(*) FILTER (q = -1) AS nowd, count(*) FILTER (q > 0 AND uid > 0) AS manual FROM entry")
def bucket_predicate_counts(t):
    return t.entry.agg(F.count("*").alias("total"), *[F.count_if(p).alias(b) for b, p in S.bucket_predicates().items()])
