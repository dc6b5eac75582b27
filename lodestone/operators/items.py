"""Items and claims to make, as JSON commands; nothing is written anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import dates, text
from lodestone.operators.matchers import by_search
from lodestone.plans.lineage import materialise

# Properties and constants of items.
INSTANCE, BORN, DIED, PLACE, ISNI = 31, 569, 570, 625, 213
PRECISION = 0.000027  # of a coordinate that doesn't say
#: Properties by whose values entries are one thing.
SHARED = (214, 227)


def _p(prop: Column) -> Column:
    return F.concat(F.lit("P"), prop.cast("string"))


def _value(prop: Column, kind: Column, value: Column) -> Column:
    """A snak as JSON; null for a datatype that plain text can't give."""
    item = F.regexp_extract(value, "^Q([0-9]+)$", 1).try_cast("bigint")
    time = dates.parse_wire(value)
    snak = lambda type_, v: F.to_json(F.struct(_p(prop).alias("property"), F.lit(type_).alias("type"), v.alias("value")))
    fixed = text.fix_external_id(prop, value, ISNI)
    return (
        F.when(kind == "wikibase-item", F.when(item.isNotNull(), snak("wikibase-entityid", F.concat(F.lit("Q"), item.cast("string")))))
        .when(kind.isin("string", "commonsMedia", "url"), snak("string", value))
        .when(kind == "external-id", snak("string", fixed))
        .when(kind == "time", F.when(time.isNotNull(), snak("time", F.concat_ws("/", time["time"], time["precision"].cast("string")))))
    )


def claims_of_aux(auxiliary: DataFrame, datatypes: DataFrame) -> DataFrame:
    """entry_id, aux_p, snak of the identifiers that can be claims; datatypes: property,
    datatype. Other datatypes, and values that aren't of theirs, are left out."""
    kinds = datatypes.select(F.col("property").alias("aux_p"), "datatype")
    made = auxiliary.join(kinds, "aux_p").withColumn("snak", _value(F.col("aux_p"), F.col("datatype"), F.col("aux_name")))
    return made.where("snak IS NOT NULL").select("entry_id", "aux_p", "snak")


def match_claims(entry: DataFrame, catalog: DataFrame, claims: DataFrame, now: str) -> DataFrame:
    """entry_id, q, property, value, references of the claim that confirms a match, for
    entries of primary catalogs whose item doesn't have it yet: the catalog's own
    identifier, with where and when it was found."""
    own = catalog.where("wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), F.col("wd_prop").alias("property"))
    rows = entry.where("q > 0").join(own, "catalog")
    there = claims.select("q", "property", F.col("value").alias("ext_id"))
    found = F.to_json(F.struct(_p(F.col("property")).alias("property"), F.col("ext_id").alias("value"), F.col("ext_url").alias("url"), F.lit(now[:8]).alias("retrieved")))
    return rows.join(there, ["q", "property", "ext_id"], "left_anti").select(F.col("id").alias("entry_id"), "q", "property", F.col("ext_id").alias("value"), found.alias("references"))


def _switches(kv_catalog: DataFrame) -> DataFrame:
    key = lambda k: F.max(F.when(F.col("kv_key") == k, F.col("kv_value")))
    return kv_catalog.groupBy(F.col("catalog_id").alias("catalog")).agg(
        F.coalesce(key("use_description_for_new") != "0", F.lit(True)).alias("use_desc"),
        F.coalesce(key("no_descriptions") == "1", F.lit(False)).alias("no_desc"),
        F.coalesce(key("no_dates_import") == "1", F.lit(False)).alias("no_dates"),
    )


def parts(entry: DataFrame, catalog: DataFrame, kv_catalog: DataFrame, aliases: DataFrame, descriptions: DataFrame, person_dates: DataFrame, location: DataFrame, auxiliary: DataFrame, datatypes: DataFrame) -> DataFrame:
    """entry_id, part, language, value: what an item for each entry would hold. Parts
    are label, alias, description and claim (a snak as JSON). A catalog's switches
    say whether descriptions and dates are used; labels of people are for all
    languages (mul), an alias that is the label is left out."""
    base = entry.join(catalog.select(F.col("id").alias("catalog"), "wd_prop", "wd_qual", "search_wp"), "catalog").join(_switches(kv_catalog), "catalog", "left")
    base = base.select("*", F.col("id").alias("entry_id")).fillna({"use_desc": True, "no_desc": False, "no_dates": False})
    out = lambda df, part, language, value: df.select("entry_id", F.lit(part).alias("part"), language.alias("language"), value.alias("value")).where("value IS NOT NULL AND value <> ''")
    own = F.nullif("search_wp", F.lit(""))
    language = F.when(F.col("type") == "Q5", "mul").otherwise(F.coalesce(own, F.lit("en")))
    name = text.sanitize_name(F.col("ext_name"))
    none = F.lit("")
    snak = lambda prop, type_, value: F.to_json(F.struct(_p(prop).alias("property"), F.lit(type_).alias("type"), value.alias("value")))
    entity = F.when(F.col("type") != "", snak(F.lit(INSTANCE), "wikibase-entityid", F.col("type")))
    native = F.when(F.col("wd_prop").isNotNull() & F.col("wd_qual").isNull(), snak(F.col("wd_prop"), "string", text.fix_external_id(F.col("wd_prop"), F.col("ext_id"), ISNI)))
    more = aliases.join(base.select("entry_id", name.alias("name")), "entry_id").where("label <> name")
    described = descriptions.join(base.where("NOT no_desc").select("entry_id", F.col("search_wp").alias("own"), F.when(F.col("use_desc"), F.col("ext_desc")).otherwise("").alias("ext_desc")), "entry_id")
    described = described.where("NOT (language = own AND ext_desc <> '')")
    lives = person_dates.join(base.where("NOT no_dates").select("entry_id"), "entry_id")
    dated = lambda column, prop: F.when(dates.parse(F.col(column)).isNotNull(), snak(F.lit(prop), "time", F.concat_ws("/", dates.wire_time(F.col(column)), dates.precision(F.col(column)).cast("string"))))
    spots = location.join(base.select("entry_id"), "entry_id")
    point = snak(F.lit(PLACE), "globecoordinate", F.concat_ws("/", F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit(str(PRECISION))))
    known = claims_of_aux(auxiliary, datatypes).join(base.select("entry_id"), "entry_id", "left_semi")
    pieces = [
        out(base, "label", language, name), out(more, "alias", F.col("language"), F.col("label")),
        out(described, "description", F.col("language"), F.col("label")), out(base.where("use_desc AND NOT no_desc"), "description", F.coalesce(own, F.lit("en")), F.col("ext_desc")),
        out(base, "claim", none, native), out(base, "claim", none, entity), out(lives, "claim", none, dated("born", BORN)), out(lives, "claim", none, dated("died", DIED)),
        out(spots, "claim", none, point), out(known, "claim", none, F.col("snak")),
    ]
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece)
    return whole.distinct()


def same_things(entries: DataFrame, auxiliary: DataFrame, props: tuple[int, ...] = SHARED) -> DataFrame:
    """entry_id, item: entries (id) that share a value of the properties, directly or by
    others, are one item, named by its smallest entry. Every entry takes the smallest
    name among those that it shares a value with, until no name changes."""
    values = materialise(auxiliary.where(F.col("aux_p").isin(*props)).select("entry_id", "aux_p", "aux_name").join(entries.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").distinct(), "items-values")
    names = entries.select(F.col("id").alias("entry_id"), F.col("id").alias("item"))
    mark = None
    while True:
        least = values.join(names, "entry_id").groupBy("aux_p", "aux_name").agg(F.min("item").alias("least"))
        better = values.join(least, ["aux_p", "aux_name"]).groupBy("entry_id").agg(F.min("least").alias("least"))
        names = names.join(better, "entry_id", "left").select("entry_id", F.least("item", F.coalesce("least", "item")).alias("item"))
        follow = names.select(F.col("entry_id").alias("item"), F.col("item").alias("up"))  # a name's own name: halves the way
        names = materialise(names.join(follow, "item", "left").select("entry_id", F.least("item", F.coalesce("up", "item")).alias("item")), "items-names")
        now = names.agg(F.sum(F.col("item").cast("decimal(38,0)"))).first()[0]
        if now == mark:
            return names
        mark = now


def merged(parts_: DataFrame, things: DataFrame) -> DataFrame:
    """item, part, language, value: what the entries of each item hold together. One
    label and one description for a language, the smallest entry's."""
    rows = parts_.join(things, "entry_id")
    single = rows.where("part IN ('label', 'description')")
    first = single.groupBy("item", "part", "language").agg(F.min_by("value", F.struct("entry_id", "value")).alias("value"))
    return first.unionByName(rows.where("part IN ('alias', 'claim')").select("item", "part", "language", "value").distinct())


def as_json(merged_: DataFrame) -> DataFrame:
    """item, data: each item as one JSON document."""
    row = F.struct("language", "value")
    of = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, row))).alias(part)
    return merged_.groupBy("item").agg(*[of(p) for p in ("label", "alias", "description", "claim")]).select("item", F.to_json(F.struct("label", "alias", "description", "claim")).alias("data"))


def to_make(entries: DataFrame, aliases: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, entries to make items for): entries of a query that are unmatched; those
    that a search finds get the hits as candidates instead."""
    open_ = entries.where(S.unmatched())
    hits = by_search(open_, aliases.limit(0), terms)
    return hits, open_.join(hits.select(F.col("entry_id").alias("id")), "id", "left_anti")


def label_codes(answers: DataFrame) -> DataFrame:
    """code, q of an answer (code, q, seq); of equal codes the last counts."""
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("seq")))
    return answers.where("code <> ''").withColumn("_rn", last).where("_rn = 1").select("code", "q")
