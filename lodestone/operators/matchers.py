"""Matchers: each gives (entry_id, q) decisions or ordered candidates, and writes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import geo, text
from lodestone.operators.candidates import AUTHORITIES, active

#: Classes whose items never are the thing itself, as P31 values.
META_CLASSES = ("Q4167410", "Q11266439", "Q4167836", "Q13406463", "Q22808320", "Q17362920")


def removed_before(log: DataFrame) -> DataFrame:
    return log.where("action = 'remove_q'").select(F.col("entry_id").alias("id")).distinct()


def meta_items(claims: DataFrame) -> DataFrame:
    return claims.where((F.col("property") == 31) & F.col("value").isin(*META_CLASSES)).select("q").distinct()


def one_item(df: DataFrame, *key: str) -> DataFrame:
    """Groups with exactly one distinct item."""
    return df.groupBy(*key).agg(F.min("q").alias("q"), F.max("q").alias("other")).where("q = other").drop("other")


#: Candidates that matter: an entry with more than ten lists none, see decisions.LISTED.
ENOUGH = 11


def _first_items(terms: DataFrame) -> DataFrame:
    """text, q: the ENOUGH smallest items of each text. What an entry lists comes from
    these, so a text of many items that many entries have doesn't multiply."""
    w = Window.partitionBy("text").orderBy("q")
    return terms.select("text", "q").distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= ENOUGH).drop("_rn")


def by_label(entry: DataFrame, aliases: DataFrame, terms: DataFrame, claims: DataFrame) -> DataFrame:
    """entry_id, candidates: items with the entry's name or an alias as a term,
    without meta items, in numeric order; the first ENOUGH of them."""
    open_ = entry.where(S.unmatched())
    names = open_.select("id", F.col("ext_name").alias("text")).unionByName(
        aliases.select(F.col("entry_id").alias("id"), F.col("label").alias("text")).join(open_.select("id"), "id", "left_semi")
    )
    items = _first_items(terms.join(meta_items(claims), "q", "left_anti"))
    found = names.distinct().join(items, "text")
    return found.groupBy(F.col("id").alias("entry_id")).agg(F.slice(F.array_sort(F.collect_set("q")), 1, ENOUGH).alias("candidates"))


def by_search(entry: DataFrame, aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """entry_id, candidates: items found by label before those found by alias, the
    first ENOUGH of them. Each distinct text is looked up once and the hits fan
    back out."""
    open_ = entry.where(S.unmatched())
    texts = open_.select("id", F.col("ext_name").alias("text"), F.lit(0).alias("rank")).unionByName(
        aliases.join(open_.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select(F.col("entry_id").alias("id"), F.col("label").alias("text"), F.lit(1).alias("rank"))
    )
    hits = texts.join(_first_items(terms), "text").groupBy("id", "q").agg(F.min("rank").alias("rank"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "q"))), lambda x: x["q"])
    return hits.groupBy(F.col("id").alias("entry_id")).agg(F.slice(ordered, 1, ENOUGH).alias("candidates"))


def by_sitelink(entry: DataFrame, catalog: DataFrame, sitelinks: DataFrame, log: DataFrame) -> DataFrame:
    """Pages of the catalog's wiki with the entry's name as title."""
    wiki = catalog.select(F.col("id").alias("catalog"), F.concat("search_wp", F.lit("wiki")).alias("site"))
    open_ = entry.where(S.unmatched()).join(removed_before(log), "id", "left_anti").join(wiki, "catalog")
    found = open_.join(sitelinks.withColumnRenamed("q", "item"), (F.col("ext_name") == F.col("title")) & (open_["site"] == sitelinks["site"]))
    return found.groupBy(F.col("id").alias("entry_id")).agg(F.min("item").alias("q"))


def from_other_catalogs(entry: DataFrame) -> DataFrame:
    """Unmatched entries whose name and type are matched, everywhere to one item."""
    known = one_item(entry.where(S.full()).withColumn("name", S.name_key(F.col("ext_name"))), "name", "type")
    open_ = entry.where(S.unmatched()).select("id", S.name_key(F.col("ext_name")).alias("name"), "type")
    return open_.join(known, ["name", "type"]).select(F.col("id").alias("entry_id"), "q")


def by_birth_year(entry: DataFrame, catalog: DataFrame, person_dates: DataFrame) -> DataFrame:
    """People with a namesake in another active catalog that is matched and was
    born or died in the same year; exactly one item in all.

    The matched side shrinks to distinct (name, year, q) with its smallest and
    largest catalog first: an item is in another catalog if one of them differs.
    That keeps a name that everybody has from multiplying.
    """
    lives = person_dates.select(F.col("entry_id").alias("id"), "year_born", "year_died")
    people = entry.where("type = 'Q5'").join(lives, "id").withColumn("name", S.name_key(F.col("ext_name")))
    keep = catalog.where("active = 1").select(F.col("id").alias("catalog"))
    known = people.where(S.full()).join(keep, "catalog", "left_semi")
    hits = []
    for year in ("year_born", "year_died"):
        side = known.where(f"{year} <> ''").groupBy("name", year, F.col("q").alias("item")).agg(F.min("catalog").alias("lo"), F.max("catalog").alias("hi"))
        open_ = people.where(S.not_full() & (F.col(year) != "")).select("id", "catalog", "name", year)
        hits.append(open_.join(side, ["name", year]).where("lo <> catalog OR hi <> catalog").select(F.col("id").alias("entry_id"), F.col("item").alias("q")))
    return one_item(hits[0].unionByName(hits[1]).distinct(), "entry_id")


def year_born_retarget(entry: DataFrame, catalog: DataFrame, person_dates: DataFrame, log: DataFrame) -> DataFrame:
    """Preliminary matches whose namesake born in the same year is matched to
    another item; entry_id, q of the smallest such item."""
    lives = person_dates.where("year_born <> ''").select(F.col("entry_id").alias("id"), "year_born")
    people = active(entry, catalog).where("type = 'Q5'").join(lives, "id").withColumn("name", S.name_key(F.col("ext_name")))
    sure = people.where(S.full()).select("name", "year_born", F.col("q").alias("item")).distinct()
    guess = people.where(S.preliminary()).join(removed_before(log), "id", "left_anti")
    hits = guess.join(sure, ["name", "year_born"]).where("q <> item")
    return hits.groupBy(F.col("id").alias("entry_id")).agg(F.min("item").alias("q"))


def by_name_and_dates(entry: DataFrame, person_dates: DataFrame) -> DataFrame:
    """Unmatched people with name and both full dates of matched ones."""
    lives = person_dates.where("length(born) = 10 AND length(died) = 10").select(F.col("entry_id").alias("id"), "born", "died")
    people = entry.join(lives, "id").withColumn("name", S.name_key(F.col("ext_name")))
    known = one_item(people.where(S.full()), "name", "born", "died")
    open_ = people.where(S.not_full()).select("id", "name", "born", "died")
    return open_.join(known, ["name", "born", "died"]).select(F.col("id").alias("entry_id"), "q")


def by_unique_name(entry: DataFrame) -> DataFrame:
    """Unmatched humans whose name has exactly one confirmed item."""
    known = one_item(entry.where(S.full() & (F.col("type") == "Q5")).withColumn("name", S.name_key(F.col("ext_name"))), "name")
    open_ = entry.where(S.unmatched() & (F.col("type") == "Q5")).select("id", S.name_key(F.col("ext_name")).alias("name"))
    return open_.join(known, "name").select(F.col("id").alias("entry_id"), "q")


def by_shared_identifier(entry: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """Entries that share an authority identifier with entries of one confirmed item."""
    rows = auxiliary.where(F.col("aux_p").isin(*AUTHORITIES)).join(entry.select(F.col("id").alias("entry_id"), "q", "uid"), "entry_id")
    known = one_item(rows.where(S.full()), "aux_p", "aux_name").withColumnRenamed("q", "item")
    hits = rows.where(S.not_full()).join(known, ["aux_p", "aux_name"]).select("entry_id", F.col("item").alias("q")).distinct()
    return one_item(hits, "entry_id")


def by_identifier(entry: DataFrame, auxiliary: DataFrame, claims: DataFrame, denied: tuple[int, ...] = (17,)) -> DataFrame:
    """entry_id, candidates: items that claim an identifier noted on the entry."""
    rows = auxiliary.where((F.col("in_wikidata") == 0) & ~F.col("aux_p").isin(*denied))
    open_ = entry.where(S.not_full()).select(F.col("id").alias("entry_id"))
    known = claims.select("q", F.col("property").alias("aux_p"), F.col("value").alias("aux_name"))
    found = rows.join(open_, "entry_id", "left_semi").join(known, ["aux_p", "aux_name"])
    return found.groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))


def by_terms_ignoring_case(entry: DataFrame, labels: DataFrame) -> DataFrame:
    """labels: label, q, seq; of equal labels the last counts."""
    w = Window.partitionBy("name").orderBy(F.desc("seq"))
    last = labels.withColumn("name", F.lower("label")).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "q")
    open_ = entry.where(S.unmatched()).select(F.col("id").alias("entry_id"), F.lower("ext_name").alias("name"))
    return open_.join(last, "name").select("entry_id", "q")


def by_full_dates(entry: DataFrame, person_dates: DataFrame, terms: DataFrame, claims: DataFrame) -> DataFrame:
    """entry_id, candidates: people found by simplified name whose years of birth
    (P569) and death (P570) are the entry's. Each distinct name with its years is looked
    up once, and an item's claims of one year count once, so that neither an item's
    claims nor namesakes multiply."""
    lives = person_dates.where("born <> '' AND died <> ''").select(F.col("entry_id").alias("id"), "year_born", "year_died")
    people = entry.where(S.not_full() & (F.col("type") == "Q5")).join(lives, "id").withColumn("text", text.simplify_name(F.col("ext_name")))
    year = F.regexp_extract("value", "^\\+?(-?[0-9]+)", 1)
    born = claims.where("property = 569").select("q", year.alias("year_born")).distinct()
    died = claims.where("property = 570").select("q", year.alias("year_died")).distinct()
    asked = people.select("text", "year_born", "year_died").distinct()
    known = asked.join(terms.select("text", "q").distinct(), "text").join(born, ["q", "year_born"], "left_semi").join(died, ["q", "year_died"], "left_semi")
    found = known.groupBy("text", "year_born", "year_died").agg(F.array_sort(F.collect_set("q")).alias("candidates"))
    return people.join(found, ["text", "year_born", "year_died"]).select(F.col("id").alias("entry_id"), "candidates")


def by_single_date(entry: DataFrame, person_dates: DataFrame, multi_match: DataFrame, claims: DataFrame, field: str = "born", prop: int = 569, length: int = 10) -> DataFrame:
    """entry_id, candidates: of an entry's candidates and its preliminary item,
    those with its date."""
    dates = person_dates.where(F.length(field) == length).select("entry_id", F.col(field).alias("date"))
    listed = multi_match.select("entry_id", F.explode(F.split("candidates", ",").cast("array<long>")).alias("q"))
    guessed = entry.where(S.preliminary()).select(F.col("id").alias("entry_id"), "q")
    open_ = entry.where(S.not_full()).select(F.col("id").alias("entry_id"))
    wanted = listed.unionByName(guessed).distinct().join(open_, "entry_id", "left_semi").join(dates, "entry_id")
    known = claims.where(F.col("property") == prop).select("q", F.col("value").alias("date")).distinct()
    return wanted.join(known, ["q", "date"]).groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))


def by_taxon_name(entry: DataFrame, claims: DataFrame) -> DataFrame:
    """entry_id, candidates: items with the name as scientific name or synonym."""
    names = entry.where(S.not_full() & (F.col("type") == "Q16521")).select(F.col("id").alias("entry_id"), text.rewrite_taxon_name(F.col("ext_name")).alias("value"))
    known = claims.where("property IN (225, 1420)").select("q", "value").distinct()
    return names.join(known, "value").groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))


def _runs(column: str, sizes: Column) -> Column:
    """Hashes of the distinct runs of characters of a text, in those sizes that it has."""
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.xxhash64(F.substr(F.col(column), i, n)))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(column)), at)))


def _held(inner: DataFrame, outer: DataFrame, part: str, whole: str) -> DataFrame:
    """Pairs in which `part` is in `whole`; both sides have a row for each text.

    A part is looked up by one of its runs of characters, which any text that holds it
    has. Runs are as long as the largest power of two that fits, so at least half the
    part, and of these the one that is rarest among the wholes is taken; a part with a
    run that no whole has is in none. Both sides can be large: the joins are merges, as
    sizes of compressed files would have one broadcast that the driver can't hold."""
    size = F.pow(F.lit(2), F.length(F.bin(F.length(part))) - 1).cast("int")
    sized = inner.select(*inner.columns, size.alias("_size"))
    sizes = sized.agg(F.collect_set("_size").alias("_sizes"))  # one row of at most 31 numbers
    spread = outer.crossJoin(F.broadcast(sizes)).select(*outer.columns, F.explode(_runs(whole, F.col("_sizes"))).alias("_run"))
    often = spread.groupBy("_run").agg(F.count("*").alias("_n"))
    runs = sized.select(*inner.columns, _runs(part, F.array("_size")).alias("_runs"))
    asked = runs.select(*inner.columns, F.size("_runs").alias("_of"), F.posexplode("_runs").alias("_at", "_run")).join(often.hint("merge"), "_run")
    place = F.shiftleft("_n", 31) + F.col("_at")  # of equally rare runs the first
    rarest = asked.groupBy(*inner.columns, "_of").agg(F.count("*").alias("_found"), F.min_by("_run", place).alias("_run")).where("_found = _of")
    return rarest.drop("_of", "_found").hint("merge").join(spread, "_run").where(F.contains(whole, part)).drop("_run")


def by_containment(entry: DataFrame, labels: DataFrame) -> DataFrame:
    """Items (q, label) whose label is in, or holds, the name of exactly one
    unmatched entry, regardless of case. Texts are compared once each: a name stands
    for its entries by the smallest and the largest, which are one if it has one."""
    open_ = entry.where(S.unmatched() & (F.col("ext_name") != "")).groupBy(F.lower("ext_name").alias("name"))
    names = open_.agg(F.min("id").alias("first"), F.max("id").alias("last"))
    items = labels.where("label <> ''").select("q", F.lower("label").alias("label"))
    texts = items.select("label").distinct()
    hits = _held(names, texts, "name", "label").unionByName(_held(texts, names, "label", "name"))
    ends = lambda df, key: df.groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    single = ends(items.join(ends(hits, "label").hint("merge"), "label"), "q").where("first = last")
    return single.select(F.col("first").alias("entry_id"), "q")


def open_without_removal(entry: DataFrame, log: DataFrame) -> DataFrame:
    """Unmatched entries that nobody took an item from before."""
    return entry.where(S.unmatched()).join(removed_before(log), "id", "left_anti")


def by_conditions(entry: DataFrame, log: DataFrame, claims: DataFrame, labels: DataFrame, roots: list[tuple[int, int]]) -> DataFrame:
    """Items that meet a catalog's conditions (property, item) and whose label is in, or
    holds, the name of exactly one of its open entries; entry_id, candidates: all of them."""
    from lodestone.operators.sync import below_roots

    known = labels.join(below_roots(claims, roots), "q", "left_semi")
    found = by_containment(open_without_removal(entry, log), known)
    return found.groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))


#: Metres within which a place counts as the same, where a catalog doesn't say.
NEAR = 500.0


def by_place(entry: DataFrame, location: DataFrame, kv_catalog: DataFrame, places: DataFrame, farthest: float = 10_000.0) -> tuple[DataFrame, DataFrame]:
    """(matches, lists): items (places: q, lat, lon, label, a row for each label) near an
    entry with a label that begins or ends with its name, brackets aside. A single
    one is a match by location; several are a list for an entry that is unmatched.

    Only catalogs that allow it (allow_location_match = yes) take part, each with
    its location_distance, at most `farthest` metres."""
    kv = lambda key: kv_catalog.where(F.col("kv_key") == key).select(F.col("catalog_id").alias("catalog"), F.col("kv_value").alias(key))
    allowed = kv("allow_location_match").where("allow_location_match = 'yes'").select("catalog")
    rows = entry.where(S.not_full()).join(allowed, "catalog", "left_semi").join(kv("location_distance"), "catalog", "left")
    name = F.lower(F.trim(F.substring_index("ext_name", "(", 1)))
    rows = rows.withColumn("reach", F.coalesce(geo.parse_distance(F.col("location_distance")), F.lit(NEAR))).select("id", "q", name.alias("name"), "reach").where("name <> ''")
    points = location.select(F.col("entry_id").alias("id"), "lat", "lon").join(rows.select("id"), "id", "left_semi")
    spots = places.select(F.col("q").alias("other_id"), "lat", "lon").distinct()
    near = geo.within(points, spots, farthest).join(rows, "id").where("metres <= reach")
    label = F.lower(F.trim("label"))
    named = near.join(places.select(F.col("q").alias("other_id"), label.alias("label")).distinct(), "other_id")
    hits = named.where(F.startswith("label", "name") | F.endswith("label", "name")).select("id", "q", F.col("other_id").alias("item")).distinct()
    found = hits.groupBy(F.col("id").alias("entry_id"), "q").agg(F.slice(F.array_sort(F.collect_set("item")), 1, ENOUGH).alias("candidates"))
    matches = found.where("size(candidates) = 1").select("entry_id", F.element_at("candidates", 1).alias("q"), F.lit(S.BY_LOCATION).cast("long").alias("uid"))
    return matches, found.where("size(candidates) > 1 AND q IS NULL").select("entry_id", "candidates")


def by_creator(entry: DataFrame, relation: DataFrame, claims: DataFrame, terms: DataFrame) -> DataFrame:
    """entry_id, candidates: works of a matched creator (properties 50 and 170)
    that have the entry's title, of more than one word, and claim this creator."""
    makers = entry.where(S.full()).select(F.col("id").alias("target_entry_id"), F.concat(F.lit("Q"), F.col("q").cast("string")).alias("value"))
    works = entry.where(S.unmatched() & F.col("ext_name").contains(" ")).select(F.col("id").alias("entry_id"), F.col("ext_name").alias("text"))
    asked = relation.where("property IN (50, 170)").select("entry_id", "target_entry_id").distinct().join(makers, "target_entry_id").join(works, "entry_id")
    known = claims.where("property IN (50, 170)").select("q", "value").distinct().join(terms.select("text", "q").distinct(), "q")
    found = asked.join(known, ["text", "value"])
    return found.groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))


def by_initials(entry: DataFrame, terms: DataFrame) -> DataFrame:
    """entry_id, candidates: terms whose words begin with the initials of a name
    like J. R. Doe and end with its last word. The last word and the first letter
    are the join key, the other initials a pattern."""
    people = entry.where(S.unmatched() & (F.col("type") == "Q5") & text.has_initials(F.col("ext_name")))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    pattern = F.concat(F.lit("^"), F.regexp_replace("ext_name", "\\. *", "\\\\S* "), F.lit("$"))
    names = people.select(F.col("id").alias("entry_id"), pattern.alias("rx"), last("ext_name").alias("last"), F.substring("ext_name", 1, 1).alias("first"))
    known = terms.select("text", "q", last("text").alias("last"), F.substring("text", 1, 1).alias("first")).distinct()
    hits = names.join(known, ["last", "first"]).where(F.rlike(F.col("text"), F.col("rx")))
    return hits.groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))


def by_inventory_number(entry: DataFrame, auxiliary: DataFrame, claims: DataFrame) -> DataFrame:
    """entry_id, candidates: items with the entry's inventory number (217) in its collection (195)."""
    numbers = auxiliary.where("aux_p = 217").select("entry_id", F.col("aux_name").alias("number"))
    places = auxiliary.where("aux_p = 195").select("entry_id", F.col("aux_name").alias("place"))
    said = claims.where("property = 217").select("q", F.col("value").alias("number")).join(claims.where("property = 195").select("q", F.col("value").alias("place")), "q")
    open_ = entry.where(S.not_full()).select(F.col("id").alias("entry_id"))
    found = numbers.join(places, "entry_id").join(open_, "entry_id", "left_semi").join(said, ["number", "place"])
    return found.groupBy("entry_id").agg(F.array_sort(F.collect_set("q")).alias("candidates"))
