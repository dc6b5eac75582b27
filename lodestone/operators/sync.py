"""Entries against the knowledge base: status, differences, redirects, edits to make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.operators.candidates import ids
from lodestone.operators.matchers import meta_items, one_item
from lodestone.operators.store import insert_ignore
from lodestone.plans.lineage import materialise


def match_status(entry: DataFrame, catalog: DataFrame, claims: DataFrame, single_value: tuple[int, ...] = (214, 227)) -> DataFrame:
    """entry_id, status: SAME, DIFFERENT, MULTIPLE, WD_MISSING of the item's
    claims of the catalog's property, or N/A without such a property."""
    own = catalog.select(F.col("id").alias("catalog"), "wd_prop", "wd_qual", "active")
    rows = entry.where(S.full()).join(own, "catalog").where("active = 1")
    said = claims.select("q", F.col("property").alias("wd_prop"), F.col("value").alias("ext_id"))
    range_ = said.groupBy("q", "wd_prop").agg(F.min("ext_id").alias("lo"), F.max("ext_id").alias("hi"))
    judged = rows.join(range_, ["q", "wd_prop"], "left").join(said.distinct().withColumn("there", F.lit(True)), ["q", "wd_prop", "ext_id"], "left")
    status = (
        F.when(F.col("wd_prop").isNull() | F.col("wd_qual").isNotNull(), "N/A")
        .when(F.col("lo").isNull(), "WD_MISSING")
        .when((F.col("lo") != F.col("hi")) & F.col("wd_prop").isin(*single_value), "MULTIPLE")
        .when(F.col("there"), "SAME")
        .otherwise("DIFFERENT")
    )
    return judged.select(F.col("id").alias("entry_id"), status.alias("status"))


def missing_claims(entry: DataFrame, catalog: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims to add: those of entries whose status is WD_MISSING."""
    todo = match_status(entry, catalog, claims).where("status = 'WD_MISSING'").select(F.col("entry_id").alias("id"))
    own = catalog.select(F.col("id").alias("catalog"), "wd_prop")
    return entry.join(todo, "id", "left_semi").join(own, "catalog").select(F.col("id").alias("entry_id"), "q", F.col("wd_prop").alias("property"), F.col("ext_id").alias("value"))


#: Properties that are never written to items.
DENIED = (233, 235, 846, 2528, 4511)


def aux_commands(entry: DataFrame, auxiliary: DataFrame, claims: DataFrame, denied: tuple[int, ...] = DENIED) -> DataFrame:
    """entry_id, q, property, value, action for the identifiers of full matches
    that aren't noted as known: `flag` where the item has this value, `mismatch`
    where another item has it, `multiple` where several have, else `add`, unless
    the item has the property with another value."""
    rows = auxiliary.where((F.col("in_wikidata") == 0) & ~F.col("aux_p").isin(*denied))
    matched = entry.where(S.full()).select(F.col("id").alias("entry_id"), "q", "type")
    rows = rows.join(matched, "entry_id").where("NOT (aux_p = 17 AND type = 'Q5')").join(meta_items(claims), "q", "left_anti")
    said = claims.select("q", F.col("property").alias("aux_p"), F.col("value").alias("aux_name"))
    holders = said.groupBy("aux_p", "aux_name").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    own = said.distinct().withColumn("own", F.lit(True))
    has = said.select("q", "aux_p").distinct().withColumn("has", F.lit(True))
    judged = rows.join(holders, ["aux_p", "aux_name"], "left").join(own, ["q", "aux_p", "aux_name"], "left").join(has, ["q", "aux_p"], "left")
    action = F.when(F.col("own"), "flag").when(F.col("lo") == F.col("hi"), "mismatch").when(F.col("lo") < F.col("hi"), "multiple").when(F.col("has"), "skip").otherwise("add")
    return judged.select("entry_id", "q", F.col("aux_p").alias("property"), F.col("aux_name").alias("value"), action.alias("action")).where("action <> 'skip'")


def several_entries(entry: DataFrame) -> DataFrame:
    """catalog, q with more than one fully matched entry."""
    found = entry.where(S.full()).groupBy("catalog", "q").agg(F.count("*").alias("cnt"), ids().alias("entry_ids"), F.array_join(F.sort_array(F.collect_list("ext_id")), ",").alias("ext_ids"))
    return found.where("cnt > 1")


def several_values(claims: DataFrame, prop: int) -> DataFrame:
    """Values of a property on more than one item."""
    found = claims.where(F.col("property") == prop).groupBy("value").agg(F.count_distinct("q").alias("cnt"), ids("q").alias("items"))
    return found.where("cnt > 1")


def differences(entry: DataFrame, catalog: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of primary properties against entries: adopt, differs or unknown."""
    own = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), F.col("wd_prop").alias("property"))
    said = claims.join(own, "property").select("catalog", "property", F.col("value").alias("ext_id"), F.col("q").alias("kb_q"))
    both = said.join(entry.select("catalog", "ext_id", F.col("id").alias("entry_id"), "q", "uid"), ["catalog", "ext_id"], "left")
    kind = F.when(F.col("entry_id").isNull(), "unknown").when(S.unmatched() | (F.col("q") <= 0), "adopt").when(F.col("q") != F.col("kb_q"), "differs").otherwise("same")
    return both.select("catalog", "ext_id", "kb_q", "entry_id", "q", kind.alias("kind")).where("kind <> 'same'")


def compare(entry: DataFrame, claims: DataFrame, catalog: int, prop: int) -> DataFrame:
    """One catalog and one property by external id: same, different, only here, only there."""
    ours = entry.where((F.col("catalog") == catalog) & S.full() & ~F.col("ext_id").like("fake_id_%")).groupBy("ext_id").agg(F.min("q").alias("our_q"))
    theirs = claims.where(F.col("property") == prop).groupBy(F.col("value").alias("ext_id")).agg(F.min("q").alias("kb_q"))
    kind = F.when(F.col("our_q").isNull(), "kb_only").when(F.col("kb_q").isNull(), "local_only").when(F.col("our_q") == F.col("kb_q"), "same").otherwise("different")
    return ours.join(theirs, "ext_id", "full_outer").withColumn("kind", kind)


def follow_redirects(entry: DataFrame, redirects: DataFrame) -> DataFrame:
    moved = redirects.where("from_q <> to_q AND from_q > 0 AND to_q > 0").select(F.col("from_q").alias("q"), "to_q")
    return entry.join(moved, "q", "left").withColumn("q", F.coalesce("to_q", "q")).select(*entry.columns)


class TooManyMissing(ValueError):
    """More items are gone than a working replica would say."""


def deleted_items(entry: DataFrame, items: DataFrame, floor: int = 50, share: float = 0.1) -> DataFrame:
    """Matched items that no longer exist; refuses if it looks like a broken source."""
    used = entry.where("q > 0").select("q").distinct()
    gone = used.join(items.select("q"), "q", "left_anti")
    counts = used.join(items.select("q").distinct().withColumn("there", F.lit(1)), "q", "left").agg(F.count("*").alias("n"), F.count("there").alias("there")).first()
    if counts["n"] - counts["there"] > max(floor, share * counts["n"]):
        raise TooManyMissing(f"{counts['n'] - counts['there']} of {counts['n']} items are missing")
    return gone


def unlink(entry: DataFrame, gone: DataFrame, catalog: int | None = None) -> DataFrame:
    """Preliminary and userless matches to the given items (q) go."""
    where = F.col("gone") & (F.col("uid").isNull() | (F.col("uid") == 0))
    if catalog is not None:
        where = where & (F.col("catalog") == catalog)
    marked = entry.join(gone.select("q").distinct().withColumn("gone", F.lit(True)), "q", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    return marked.select(*[F.when(where, F.lit(None)).otherwise(F.col(c)).alias(c) if c in ("q", "uid", "ts") else F.col(c) for c in entry.columns])


def fix_matched_items(entry: DataFrame, redirects: DataFrame, items: DataFrame, claims: DataFrame) -> DataFrame:
    """Redirects followed, deleted and meta items unlinked."""
    moved = follow_redirects(entry, redirects)
    known = items.unionByName(redirects.select(F.col("to_q").alias("q")))
    return unlink(unlink(moved, deleted_items(moved, known)), meta_items(claims))


def non_humans(entry: DataFrame, claims: DataFrame) -> DataFrame:
    """Algorithmic matches of humans to items that aren't human, or aren't there."""
    human = claims.where("property = 31 AND value = 'Q5'").select("q").distinct()
    return entry.where("q > 0 AND type = 'Q5' AND uid IN (3, 4)").join(human, "q", "left_anti").select(F.col("id").alias("entry_id"), "q")


def adopt_claims(entry: DataFrame, claims: DataFrame, catalog: int, prop: int) -> DataFrame:
    """Decisions from claims of a property for entries that aren't fully matched."""
    said = one_item(claims.where(F.col("property") == prop).select(F.col("value").alias("ext_id"), "q"), "ext_id").withColumnRenamed("q", "item")
    open_ = entry.where((F.col("catalog") == catalog) & S.not_full())
    return open_.join(said, "ext_id").select(F.col("id").alias("entry_id"), F.col("item").alias("q"))


def copy_missing(entry: DataFrame, source: int, target: int) -> DataFrame:
    """Entries of source whose external id target lacks, as unmatched rows of target."""
    there = entry.where(F.col("catalog") == target).select("ext_id")
    new = entry.where(F.col("catalog") == source).join(there, "ext_id", "left_anti")
    blank = {c: F.lit(None).cast(t) for c, t in (("id", "long"), ("q", "long"), ("uid", "long"), ("ts", "string"))}
    return new.withColumns({"catalog": F.lit(target).cast("long"), **blank}).select(*entry.columns)


def mergeable(entry: DataFrame, source: int, target: int) -> DataFrame:
    """Full matches of source for entries of target with the same external id that
    aren't matched by a person and have another item, or none."""
    a = entry.where((F.col("catalog") == source) & S.full()).select("ext_id", F.col("q").alias("new_q"), F.col("uid").alias("new_uid"))
    b = entry.where((F.col("catalog") == target) & S.not_full()).select("ext_id", F.col("id").alias("entry_id"), "q")
    return b.join(a, "ext_id").where(~F.col("q").eqNullSafe(F.col("new_q"))).select("entry_id", "new_q", "new_uid")


def merge_catalogs(entry: DataFrame, source: int, target: int, now: str) -> DataFrame:
    """entry after source's missing rows and matches went to target."""
    from lodestone.operators.decisions import apply_matches

    last = entry.agg(F.max("id").alias("last"))
    new = copy_missing(entry, source, target).crossJoin(F.broadcast(last))  # one row
    ranked = new.withColumn("id", F.col("last") + 1 + F.monotonically_increasing_id()).drop("last")
    both = entry.unionByName(ranked)
    found = mergeable(both, source, target).select("entry_id", F.col("new_q").alias("q"), F.col("new_uid").alias("uid"))
    empty_log = entry.sparkSession.createDataFrame([], "entry_id long, q long")
    return apply_matches(both, found, empty_log, now)


def migrate_property(entry: DataFrame, old: int, new: int) -> DataFrame:
    """Pairs of entries of two catalogs with a name that is unique in each; the
    match moves in full if descriptions agree, else as a preliminary one."""
    from lodestone.functions.text import description_check

    def unique(c: int, tag: str) -> DataFrame:
        rows = entry.where(F.col("catalog") == c).groupBy(S.name_key(F.col("ext_name")).alias("name"))
        cols = ["id", "ext_desc", "q", "uid"]
        return rows.agg(F.count("*").alias("n"), *[F.min(x).alias(f"{tag}_{x}") for x in cols]).where("n = 1").drop("n")

    a, b = unique(old, "old").where("old_q > 0 AND old_uid > 0"), unique(new, "new").where("new_q IS NULL OR new_uid = 0")
    sure = description_check(F.col("old_ext_desc"), F.col("new_ext_desc"))
    return a.join(b, "name").select(F.col("new_id").alias("entry_id"), F.col("old_q").alias("q"), F.when(sure, F.col("old_uid")).otherwise(F.lit(0)).cast("long").alias("uid"))


def merge_claims(claims: DataFrame) -> DataFrame:
    """claims: item, main, qualifiers array<string>, refs array<string>. Claims with
    the same main value and qualifiers, in any order, become one with all references."""
    key = F.array_sort("qualifiers").alias("qualifiers")
    return claims.groupBy("item", "main", key).agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"))


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All q below the roots along edges (q, target_q), however deep. Visited nodes are
    left out of each step, so cycles end; the steps are folded into one table at
    every eighth, so the plan stays short."""
    seen = roots.select("q").distinct()
    front, step = seen, 0
    while True:
        below = edges.join(front.withColumnRenamed("q", "target_q"), "target_q", "left_semi").select("q").distinct()
        front = materialise(below.join(seen, "q", "left_anti"), "closure")
        if front.isEmpty():
            return seen
        seen, step = seen.unionByName(front), step + 1
        if step % 8 == 0:
            seen = materialise(seen, "closure")


def below_roots(claims: DataFrame, roots: list[tuple[int, int]]) -> DataFrame:
    """q of the items that meet all (property, item) conditions: instances (31) of the
    class or one below it (279), places (131) in it at any depth, else the claim itself."""
    value = F.regexp_extract("value", "^Q([0-9]+)$", 1).try_cast("bigint")
    said = claims.select("q", "property", value.alias("target_q")).where("target_q IS NOT NULL")
    edges = lambda p: said.where(F.col("property") == p).select("q", "target_q")
    out = None
    for prop, root in roots:
        start = claims.sparkSession.createDataFrame([(root,)], "q long")
        if prop == 31:
            classes = closure(edges(279), start).withColumnRenamed("q", "target_q")
            found = edges(31).join(classes, "target_q", "left_semi").select("q").distinct()
        elif prop == 131:
            found = closure(edges(131), start)
        else:
            found = edges(prop).where(F.col("target_q") == root).select("q").distinct()
        out = found if out is None else out.join(found, "q", "left_semi")
    return out


def overwrite(entry: DataFrame, catalog: DataFrame, claims: DataFrame, id_: int, now: str) -> DataFrame:
    """entry after the full matches of a catalog took the items that claim their
    external ids, where these differ: the one rewrite that full matches aren't
    protected from. The catalog must be active, with a primary property that is
    claimed at all; of several items that claim an id the largest counts."""
    own = catalog.where((F.col("id") == id_) & (F.col("active") == 1) & F.col("wd_prop").isNotNull() & F.col("wd_qual").isNull())
    said = claims.join(own.select(F.col("wd_prop").alias("property")), "property", "left_semi").where("value <> ''")
    said = said.groupBy(F.trim("value").alias("ext_id")).agg(F.max("q").alias("kb_q"))
    if said.isEmpty():
        raise ValueError(f"catalog {id_} has no primary property with claims")
    both = entry.join(said.withColumn("catalog", F.lit(id_).cast("long")), ["catalog", "ext_id"], "left")
    hit = S.full() & (F.col("kb_q") != F.col("q"))
    new = {"q": F.col("kb_q"), "uid": F.lit(S.BY_IDENTIFIER).cast("long"), "ts": F.lit(now)}
    return both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in entry.columns])


def item_json(entry: DataFrame, aliases: DataFrame, person_dates: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """entry_id, data: the item to create for an unmatched entry, as JSON."""
    from lodestone.functions.text import sanitize_name

    extra = aliases.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct("language", F.col("label").alias("value")))).alias("aliases"))
    known = auxiliary.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.struct(F.col("aux_p").alias("property"), F.col("aux_name").alias("value")))).alias("claims"))
    lives = person_dates.select("entry_id", F.nullif("born", F.lit("")).alias("P569"), F.nullif("died", F.lit("")).alias("P570"))
    rows = entry.where(S.unmatched()).select(F.col("id").alias("entry_id"), "type", "ext_name", "ext_desc")
    rows = rows.join(extra, "entry_id", "left").join(known, "entry_id", "left").join(lives, "entry_id", "left")
    label = F.struct(F.when(F.col("type") == "Q5", "mul").otherwise("en").alias("language"), sanitize_name(F.col("ext_name")).alias("value"))
    return rows.select("entry_id", F.to_json(F.struct(label.alias("label"), F.col("ext_desc").alias("description"), "type", "aliases", "claims", "P569", "P570")).alias("data"))


def record_status(wd_matches: DataFrame, status: DataFrame) -> DataFrame:
    return insert_ignore(status, wd_matches.join(status.select("entry_id"), "entry_id", "left_anti"), ["entry_id"])
