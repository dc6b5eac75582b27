import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, text
from lodestone.operators import control, decisions, maintenance, matchers, overview, scripts, store, sync
from lodestone.plans import lineage
from lodestone.plans.entry_query import Download, EntryQuery, Listing, Search
from lodestone.schema import TABLES
from lodestone.sinks import text as sinks
from lodestone.sources import meta_entry, scraper
from lodestone.sources.tabular import TabularSource, preview
from lodestone.streaming import feeds

ENTRY = [
    (1, 1, "a", "", "Jane Doe", "painter 1900", 5, 9, "t", "Q5"), (2, 1, "b", "", "jane doe ", "", None, None, None, "Q5"), (3, 2, "c", "", "Jane Doe", "", 5, 0, "t", "Q5"),
    (4, 2, "d", "", "Rex", "dog", 0, 9, "t", ""), (5, 2, "e", "", "Rex", "", -1, 9, "t", ""), (6, 3, "f", "", "Rex", "", 7, 4, "t", "Q16521"), (7, 3, "A", "", "A&amp;B", "", 7, 3, "t", "Q5"),
]


@pytest.fixture(scope="module")
def table(spark):
    return lambda name, rows: spark.createDataFrame(rows, TABLES[name].ddl)


@pytest.fixture(scope="module")
def entry(table):
    return table("entry", ENTRY)


@pytest.fixture(scope="module")
def catalog(table):
    return table("catalog", [(k, f"c{k}", "", "", "", p, None, "en", a, 0, "") for k, p, a in ((1, 214, 1), (2, None, 1), (3, 215, 0))])


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_veto_of_the_log_and_of_full_matches(entry, table, spark):
    new = spark.createDataFrame([(1, 9, 4), (2, 9, 0), (3, 9, 0), (4, 9, 3), (5, 9, 12), (6, 9, 0), (2, 8, 4)], "entry_id long, q long, uid long")
    log = table("log", [(1, "remove_q", 2, 9, "t", None), (2, "remove_q", 3, 9, "t", 8)])
    assert as_set(decisions.accepted(entry, new, log), "id", "new_q", "new_uid") == {(3, 9, 0), (5, 9, 12), (2, 8, 4)}
    once = decisions.apply_matches(entry, new.where("entry_id <> 2"), log, "now")
    twice = decisions.apply_matches(once, new.where("entry_id <> 2"), log, "later")
    assert as_set(once, "*") == as_set(twice, "*") and once.columns == entry.columns


def test_candidates_to_decisions(spark):
    found = spark.createDataFrame([(1, [5]), (2, [5, 6]), (3, []), (4, list(range(1, 11))), (5, list(range(1, 12)))], "entry_id long, candidates array<long>")
    matches, issues = decisions.unique_or_issue(found)
    assert as_set(matches, "*") == {(1, 5)} and as_set(issues, "entry_id") == {(2,), (4,), (5,)}
    first, lists = decisions.first_and_list(found)
    assert as_set(first, "*") == {(1, 5), (2, 5), (4, 1), (5, 1)} and as_set(lists, "entry_id", "candidate_count") == {(2, 2), (4, 10)}


def test_unmatch_logs_only_full_matches(entry):
    out, log = decisions.unmatch(entry, F.lit(True))
    assert out.where("q IS NOT NULL OR uid IS NOT NULL").isEmpty() and as_set(log, "entry_id") == {(1,), (6,), (7,)}


def test_overview_change_equals_recount(entry):
    after, _ = decisions.unmatch(entry, F.col("catalog") == 2)
    change = overview.delta(entry.where("catalog = 2"), after.where("catalog = 2"))
    want = as_set(overview.classified(after), "catalog", "total", "noq", "autoq", "na", "nowd", "manual")
    assert as_set(overview.apply_delta(overview.classified(entry), change), "catalog", "total", "noq", "autoq", "na", "nowd", "manual") == want


def test_names_match_regardless_of_case_and_blanks(entry):
    assert as_set(matchers.from_other_catalogs(entry), "*") == {(2, 5)}
    assert as_set(matchers.by_unique_name(entry), "*") == {(2, 5)}


def test_search_order_and_label_order(entry, table):
    aliases = table("aliases", [(2, "en", "Janey", 0)])
    terms = table("kb_terms", [("jane doe ", 30, "en"), ("Janey", 4, "en"), ("Janey", 40, "en")])
    assert matchers.by_search(entry, aliases, terms).first().candidates == [30, 4, 40]
    claims = table("kb_claims", [(40, 31, "Q4167410")])
    assert matchers.by_label(entry, aliases, terms, claims).first().candidates == [4, 30]


def test_birth_year_ignores_the_own_catalog(spark, table, catalog):
    rows = [(1, 1, "a", "", "X Y", "", None, None, None, "Q5"), (2, 1, "b", "", "x y", "", 8, 9, "t", "Q5"), (3, 2, "c", "", "X Y", "", 9, 9, "t", "Q5")]
    lives = table("person_dates", [(k, "1900", "", "1900", "") for k in (1, 2, 3)])
    assert as_set(matchers.by_birth_year(table("entry", rows), catalog, lives), "*") == {(1, 9)}


def test_deleted_items_need_a_working_source(entry, table):
    assert as_set(sync.deleted_items(entry, table("kb_items", [(5,)])), "q") == {(7,)}
    with pytest.raises(sync.TooManyMissing):
        sync.deleted_items(entry, table("kb_items", []), floor=1)


def test_unlink_spares_people(entry, table):
    out = sync.unlink(entry, table("kb_items", [(5,), (7,)]))
    assert as_set(out.where("q IS NULL"), "id") == {(2,), (3,)}


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (9, 8)], "q long, target_q long")
    assert as_set(sync.closure(edges, spark.createDataFrame([(1,)], "q long")), "q") == {(1,), (2,), (3,)}


def test_closure_has_no_depth(spark):
    edges = spark.range(1, 61).selectExpr("id AS q", "id - 1 AS target_q")
    assert sync.closure(edges, spark.range(1).selectExpr("id AS q")).count() == 61


def test_of_new_rows_with_one_key_one_is_written(spark):
    old = spark.createDataFrame([(1, 1.0), (5, 5.0)], "entry_id long, lat double")
    new = spark.createDataFrame([(1, 2.0), (1, 3.0), (1, None), (2, 4.0)], "entry_id long, lat double")
    assert as_set(store.upsert(old, new, ["entry_id"]), "*") == {(1, 3.0), (2, 4.0), (5, 5.0)}
    assert as_set(store.upsert(old, new, ["entry_id"], [F.col("lat").asc_nulls_last()]), "*") == {(1, 2.0), (2, 4.0), (5, 5.0)}


def test_entities_that_are_rare_go_to_python_and_no_others(spark):
    rows = spark.createDataFrame([("a &amp; b",), ("&amp;lt; &eacute;&#233;",), ("&lt;x&gt; &quot;&#39;&nbsp;",), ("&amp;lt;",), ("R&D &copy",), (None,), ("",)], "t string")
    import html

    got = [r[0] for r in rows.select(text.decode_entities(F.col("t"))).collect()]
    assert got == [r.t and html.unescape(r.t) if r.t is not None else None for r in rows.collect()]


def test_scripts(spark, entry):
    code = "def run(o):\n    setAux(17, o.ext_name)\n    setMatch('Q5')\n    return re_match('([0-9]{4})', o.ext_desc)"
    result, commands = scripts.dry_run(code, {"id": 1, "ext_name": "N", "ext_desc": "born 1900"})
    assert result == ["1900"] and [(c["seq"], c["kind"]) for c in commands] == [(0, "setAux"), (1, "setMatch")]
    with pytest.raises(scripts.TooLong):
        scripts.dry_run("def run(o):\n    while True:\n        x = 1", {})
    with pytest.raises(NameError):
        scripts.dry_run("def run(o):\n    open('x')", {})
    with pytest.raises(ImportError):
        scripts.dry_run("import os\ndef run(o):\n    return 1", {})
    with pytest.raises(SyntaxError):
        scripts.person_dates(entry, "def run(o", 1)
    fails = "def run(o):\n    if o.id == 2:\n        return 1 / 0\n    setAux(1, str(o.id))"
    assert as_set(scripts.commands_from_description(entry, fails, 1), "entry_id", "value") == {(1, "1")}
    for value in ("1900", "7.3.1920", "3. 1920", "7 March 1920", "März 1920", "May 7, 1920", " some day", "15 août 900"):
        assert scripts.dp(value) == spark.range(1).select(dates.parse_text(F.lit(value))).first()[0]
    assert scripts.ml("Gennaio") == "jan" and scripts.clean_html("<p>a&nbsp;&amp; b</p>") == "a & b" and scripts.json_decode("[1]") == [1]


def test_a_page_of_a_feed_as_atom(entry, spark):
    changes = spark.createDataFrame([("remove_q", 7, "20240101120000")], "event string, entry_id long, ts string")
    page = sinks.changes_feed(changes, entry, "http://x/").collect()
    xml = sinks.atom(page, "All & more", "http://x/", "2024-01-02T00:00:00+00:00")
    assert "All &amp; more" in xml and 'Match was removed for "A&amp;amp;B"' in xml and "2024-01-01T12:00:00+00:00" in xml


def test_sources_that_answer_with_too_little(spark, entry, catalog, table):
    with pytest.raises(control.TooFewRows):
        control.replace_table(entry, 8)
    with pytest.raises(ValueError):
        sync.overwrite(entry, catalog, table("kb_claims", [(1, 999, "x")]), 1, "now")
    with pytest.raises(lineage.NoSharedFolder):
        lineage.shared_dir(type("S", (), {"conf": {"spark.master": "yarn"}})())


def test_claims_merge_by_qualifiers_in_any_order(spark):
    rows = [("i", "m", ["a", "b"], ["r1"]), ("i", "m", ["b", "a"], ["r2", "r1"]), ("i", "m", [], ["r3"])]
    out = sync.merge_claims(spark.createDataFrame(rows, "item string, main string, qualifiers array<string>, refs array<string>"))
    assert {(r.n, tuple(r.refs)) for r in out.collect()} == {(2, ("r1", "r2")), (1, ("r3",))}


def test_writes_by_key(spark, entry, table):
    dates = table("person_dates", [(1, "1900", "", "1900", "")])
    new = store.dated(spark.createDataFrame([(1, "1901-02", "1950"), (2, "-500", "")], "entry_id long, born string, died string"))
    assert as_set(store.upsert(dates, new, ["entry_id"]), "entry_id", "year_born", "year_died") == {(1, "1901", "1950"), (2, "-500", "")}
    long = entry.withColumns({"ext_name": F.lit("x" * 200), "ext_desc": F.lit("y" * 400)})
    assert as_set(store.cut_text(long).select(F.length("ext_name"), F.length("ext_desc")), "*") == {(127, 254)}
    assert as_set(maintenance.decode_names(entry).where("id = 7"), "ext_name") == {("A&B",)}


def test_entry_query(entry, catalog, table):
    empty = [table(n, []) for n in ("person_dates", "auxiliary", "location")]
    assert as_set(EntryQuery(name_regexp="^JANE", state=(True, True, False)).run(entry, *empty), "id") == {(2,), (3,)}
    assert EntryQuery(min_aux=1).run(entry, *empty).isEmpty()
    with pytest.raises(ValueError):
        EntryQuery(ext_ids=("a",)).run(entry, *empty)
    with pytest.raises(ValueError):
        EntryQuery(min_dates=3).run(entry, *empty)
    assert as_set(Search(("doe", "jane")).run(entry, catalog), "id") == {(1,), (2,), (3,)}
    assert as_set(Listing(2, show_na=False).run(entry, table("multi_match", [])), "id") == {(3,), (5,)}
    lists = table("multi_match", [(2, 1, "1,2", 2), (1, 1, "1,2", 2)])
    assert as_set(Listing(1, multiple=True).run(entry, lists), "id") == {(2,)}
    rows = Download((1, 2), hide=("automatched",)).run(entry, table("users", []), *empty[:1], empty[2], lists)
    assert as_set(rows, "entry_id") == {(1,), (4,), (5,)}  # no user compares as unknown


def test_tabular_import(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('﻿x1\tJane Doe\tsome 1869-1961; viaf:"123"; isni:"0000 1"\tQ7\n\tno id\tx\t\nx2\tRex\n', encoding="utf-8")
    source = TabularSource(
        9, ("id", "name", "desc", "q"), url_pattern="http://x/$1", default_type="person",
        patterns=(("born", 2, r"(\d{4})-\d{4}"), ("died", 2, r"\d{4}-(\d{4})"), ("P214", 2, r'viaf:"(.+?)"'), ("P213", 2, r'isni:"(.+?)"')),
    )
    rows = source.read(spark, str(tmp_path / "t.tsv"))
    one, two = sorted(source.entries(rows).collect(), key=lambda r: r.ext_id)
    assert (one.ext_id, one.ext_url, one.type, one.q, one.uid, one.born, one.died) == ("x1", "http://x/x1", "Q5", 7, 4, "1869", "1961")
    assert {(a.prop_numeric, a.value) for a in one.auxiliary} == {(214, "123"), (213, "0000 1")} and two.ext_desc == "" and two.auxiliary == []
    assert source.counts(rows).first().asDict() == {"total": 3, "with_id": 2, "errors": 0}
    for k in (1, 2):
        (tmp_path / f"many{k}.tsv").write_bytes(b"id\tname\n" + f"a{k}\tA\nb{k}\tB\n".encode() + b"\xff\xfe\tC\n")
    headed = TabularSource(9, ("id", "name"), skip_rows=1).read(spark, str(tmp_path / "many*.tsv"))
    assert as_set(headed.where("_c1 <> 'C'"), "_c0") == {("a1",), ("b1",), ("a2",), ("b2",)}
    assert TabularSource(9, ("id", "name")).counts(headed).first().asDict() == {"total": 4, "with_id": 4, "errors": 2}
    assert preview(spark, str(tmp_path / "t.tsv"), rows=1).first().cells[:2] == ["x1", "Jane Doe"]
    with pytest.raises(ValueError):
        TabularSource(9, ("id", "name", "nonsense"))
    with pytest.raises(ValueError):
        TabularSource(9, ("id", "desc"))


@pytest.mark.parametrize("mode, ids", [("add", {"a", "b", "new"}), ("add_replace", {"a", "b", "new"}), ("add_replace_delete", {"a", "new"})])
def test_import_protects_matches(spark, entry, mode, ids):
    old = entry.where("catalog = 1")
    new = spark.createDataFrame([(1, "NEW", "", "N", "", None, None, None, "Q5"), (1, "new", "", "N", "", None, None, None, "Q5")] + ([(1, "A", "u", "Other", "", 3, 0, "n", "")] if mode != "add_replace_delete" else []),
                                "catalog long, ext_id string, ext_url string, ext_name string, ext_desc string, q long, uid long, ts string, type string")
    out = meta_entry.import_entries(old, new, mode)
    assert {r.ext_id.lower() for r in out.collect()} == ids and out.count() == len(ids)
    jane = out.where("id = 1").first()
    assert (jane.q, jane.uid) == (5, 9) and jane.ext_name == ("Other" if mode == "add_replace" else "Jane Doe")


def test_meta_entries(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"entry":{"catalog":1,"ext_id":"a","ext_name":"N","type":"person"},"aliases":[{"language":"en","value":"M"}],"descriptions":{"de":"x"},"person_dates":{"born":"1900","died":""}}\n')
    flat = meta_entry.flatten(meta_entry.read(spark, str(tmp_path / "m.jsonl")))
    assert as_set(flat["entry"], "ext_id", "type") == {("a", "Q5")} and as_set(flat["aliases"], "label") == {("M",)}
    assert as_set(flat["descriptions"], "language", "label") == {("de", "x")} and flat["location"].isEmpty() and flat["auxiliary"].isEmpty()
    (tmp_path / "bad.jsonl").write_text("{nonsense\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        meta_entry.read(spark, str(tmp_path / "bad.jsonl")).collect()


def test_scraper(spark):
    html = "<ul><li><a href='/x1'>One &amp; only</a></li>\n<li><a href='/x2'>Two</a></li></ul><p>skip <a href='/x3'>no</a></p>"
    pages = spark.createDataFrame([(1, html, "k")], "page_id long, html string, l1 string")
    spec = scraper.Scraper(((r"<b>(.*?)</b>", 1), (r"<a href='/(\w+)'>(.*?)</a>", 2)), {"ext_id": scraper.Field("$L1-$1", (("x", "y"),)), "name": scraper.Field("$2")}, rx_block="<ul>(.*?)</ul>")
    assert as_set(spec.entries(pages), "ext_id", "name") == {("k-y1", "One & only"), ("k-y2", "Two")}
    urls = scraper.urls([scraper.keys_level(spark, ["a", "b"], "k"), scraper.range_level(spark, 1, 5, 2, "n")], "http://x/$1/$2")
    assert urls.count() == 6 and as_set(urls.where("k = 'b' AND n = '5'"), "url") == {("http://x/b/5",)}
    lines = spark.createDataFrame([('<http://x/Q5>\t"a \\"b\\""@en\t7',)], "value string")
    assert as_set(scraper.sparql_tsv(lines, ["u", "l", "n"]), "*") == {("http://x/Q5", 'a "b"', "7")}


def test_feed_runs_to_its_end_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "noq", 1), (1, "noq", -1), (1, "manual", 1), (2, "noq", 1)], "catalog long, bucket string, n int")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        feeds.run_batches(stream, feeds.running_overview, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert as_set(out, "catalog", "total", "noq", "manual") == {(1, 1, 0, 1), (2, 1, 1, 0)}
    lines = spark.createDataFrame([('{"item": 5}',), ("{bad",)], "value string")
    assert as_set(feeds.parse_lines(lines, "item long"), "item") == {(5,)}
    with pytest.raises(feeds.BadFeed):
        feeds.parse_lines(lines.where("value LIKE '{bad%'"), "item long")
    assert feeds.parse_lines(lines.where("false"), "item long").isEmpty()
