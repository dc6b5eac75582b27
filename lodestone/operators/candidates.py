"""Groups of entries that probably mean one thing: names, dates, identifiers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S

#: Properties of authority files.
AUTHORITIES = (214, 227, 1207, 1273, 244)


class Groups(NamedTuple):
    """Groups by key with their counts, and the rows (key, entry_id) of their members.
    A group of any size is counted without being gathered: lists of members are
    made, by `listed`, only where a report shows them."""

    key: tuple[str, ...]
    counts: DataFrame
    rows: DataFrame

    @property
    def members(self) -> DataFrame:
        """key, entry_id, once each, of the groups that count."""
        return self.rows.join(self.counts.select(*self.key), list(self.key), "left_semi").distinct()

    def listed(self) -> DataFrame:
        """The counts with each group's members as text, for a report."""
        texts = self.members.groupBy(*self.key).agg(ids("entry_id").alias("entry_ids"))
        return self.counts.join(texts, list(self.key), "left").withColumn("entry_ids", F.coalesce("entry_ids", F.lit("")))


def grouped(rows: DataFrame, key: list[str], having: Column, *counts: Column, id_: str = "id", member: Column | None = None) -> Groups:
    """Groups of rows whose counts meet `having`; of the rows that `member` takes, if
    given, the group lists the ids. Columns that `having` alone needs begin with _."""
    found = rows.groupBy(*key).agg(*counts).where(having)
    kept = found.select(*[c for c in found.columns if not c.startswith("_")])
    chosen = rows if member is None else rows.where(member)
    return Groups(tuple(key), kept, chosen.select(*key, F.col(id_).alias("entry_id")))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("name", S.name_key(F.col("ext_name")))


#: Rules up to which the table of them is sent to every executor.
RULES = 10_000


def ids(column: str = "id", where: Column | None = None) -> Column:
    """Sorted distinct ids as text, separated by commas."""
    chosen = F.col(column) if where is None else F.when(where, F.col(column))
    return F.array_join(F.transform(F.array_sort(F.collect_set(chosen)), lambda x: x.cast("string")), ",")


def active(entry: DataFrame, catalog: DataFrame, *more: Column) -> DataFrame:
    """Entries of active catalogs. Catalogs are joined without a hint: they are
    few, and adaptive execution sees their size."""
    keep = catalog.where("active = 1")
    for condition in more:
        keep = keep.where(condition)
    return entry.join(keep.select(F.col("id").alias("catalog")), "catalog", "left_semi")


def common_names_dates(entry: DataFrame, catalog: DataFrame, person_dates: DataFrame, least: int = 3) -> Groups:
    """Name and both dates alike in several active catalogs, none of them matched."""
    lives = person_dates.where("year_born <> '' AND year_died <> ''").select(F.col("entry_id").alias("id"), "year_born", "year_died")
    rows = _named(active(entry, catalog).where("type = 'Q5'").join(lives, "id"))
    counts = F.count_distinct("catalog").alias("cnt"), F.max(F.when(S.full(), 1).otherwise(0)).alias("_matched")
    return grouped(rows, ["name", "year_born", "year_died"], (F.col("cnt") >= least) & (F.col("_matched") == 0), *counts)


def common_names_birth_year(entry: DataFrame, catalog: DataFrame, person_dates: DataFrame, least: int = 3, before: int = 1960) -> Groups:
    """Unmatched entries of one name, of more than one word, and one year of birth."""
    lives = person_dates.where(F.col("year_born").try_cast("int") < before).select(F.col("entry_id").alias("id"), "year_born")
    rows = _named(active(entry, catalog).where(S.unmatched() & F.col("ext_name").rlike(r"\S \S")).join(lives, "id"))
    return grouped(rows, ["name", "year_born"], F.col("cnt") >= least, F.count("*").alias("cnt"))


def common_names_human(entry: DataFrame, catalog: DataFrame, least: int = 5) -> Groups:
    """Names of three words in several active catalogs, all unmatched."""
    rows = active(entry, catalog).where(S.unmatched() & (F.col("type") == "Q5") & F.col("ext_name").like("____% ____% ____%"))
    return grouped(_named(rows), ["name"], F.col("cnt") >= least, F.count_distinct("catalog").alias("cnt"))


def common_taxa(entry: DataFrame, catalog: DataFrame, least: int = 4) -> Groups:
    """Names of two words in several active catalogs of taxa, all unmatched."""
    rows = active(entry, catalog).where(S.unmatched() & (F.col("type") == "Q16521") & F.col("ext_name").rlike(r"^\S+ \S+$"))
    return grouped(_named(rows), ["name"], F.col("cnt") >= least, F.count_distinct("catalog").alias("cnt"))


def common_names(entry: DataFrame, catalog: DataFrame, least: int = 3, most: int = 6) -> Groups:
    """Unmatched names in a few active catalogs."""
    rows = _named(active(entry, catalog).where(S.unmatched()))
    return grouped(rows, ["name"], F.col("cnt").between(least, most), F.count_distinct("catalog").alias("cnt"))


def common_artwork(entry: DataFrame, catalog: DataFrame, relation: DataFrame) -> Groups:
    """Titles that several catalogs give works of one matched creator, each with its own URL."""
    works = active(entry, catalog).where(S.unmatched() & (F.col("type") == "Q838948"))
    creators = entry.where(S.full()).select(F.col("id").alias("target_entry_id"), F.col("q").alias("creator"))
    edges = relation.where("property = 170").select(F.col("entry_id").alias("id"), "target_entry_id")
    rows = _named(works.join(edges, "id").join(creators, "target_entry_id"))
    counts = F.count_distinct("catalog").alias("cnt"), F.count_distinct("id").alias("_n"), F.count_distinct("ext_url").alias("_urls")
    return grouped(rows, ["name", "creator"], (F.col("cnt") >= 2) & (F.col("_n") == F.col("_urls")), *counts)


def common_aux(auxiliary: DataFrame, entry: DataFrame, least: int = 3) -> Groups:
    """Authority identifiers on several entries, not all of them matched; the members
    are those that aren't."""
    rows = auxiliary.where(F.col("aux_p").isin(*AUTHORITIES)).join(entry.select(F.col("id").alias("entry_id"), "q"), "entry_id")
    counts = F.count("*").alias("cnt"), F.count_if(F.col("q").isNull()).alias("unmatched")
    having = (F.col("cnt") >= least) & (F.col("unmatched") > 0)
    return grouped(rows, ["aux_p", "aux_name"], having, *counts, id_="entry_id", member=F.col("q").isNull())


def aux_candidates(auxiliary: DataFrame, entry: DataFrame, catalog: DataFrame, least: int = 3) -> Groups:
    """Identifiers, native to a catalog or noted on entries, that several unmatched
    entries and no matched one carry."""
    own = catalog.where("active = 1 AND wd_prop IS NOT NULL AND wd_qual IS NULL").select(F.col("id").alias("catalog"), "wd_prop")
    native = entry.join(own, "catalog").select("id", F.col("wd_prop").alias("aux_p"), F.col("ext_id").alias("aux_name"), "q")
    noted = auxiliary.join(entry.select(F.col("id").alias("entry_id"), "q"), "entry_id").select(F.col("entry_id").alias("id"), "aux_p", "aux_name", "q")
    having = (F.col("cnt") >= least) & (F.col("_matched") == 0)
    return grouped(native.unionByName(noted), ["aux_p", "aux_name"], having, F.count("*").alias("cnt"), F.count_if(F.col("q") > 0).alias("_matched"))


def relations_as_aux(relation: DataFrame, entry: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """Edges to matched entries as identifiers 'Q...', where they aren't noted yet."""
    targets = entry.where("q > 0 AND uid > 0").select(F.col("id").alias("target_entry_id"), "q")
    made = relation.where("property IN (50, 170)").join(targets, "target_entry_id")
    made = made.select("entry_id", F.col("property").alias("aux_p"), F.concat(F.lit("Q"), F.col("q").cast("string")).alias("aux_name")).distinct()
    return made.join(auxiliary, ["entry_id", "aux_p", "aux_name"], "left_anti")


def crossmatch_groups(auxiliary: DataFrame, props: tuple[int, ...] = AUTHORITIES) -> Groups:
    """Identifiers shared by entries of which some aren't matched."""
    rows = auxiliary.where(F.col("aux_p").isin(*props))
    having = (F.col("_n") > 1) & (F.col("_n") > F.col("_m"))
    return grouped(rows, ["aux_p", "aux_name"], having, F.count("*").alias("_n"), F.sum("entry_is_matched").alias("_m"), id_="entry_id")


def describe_rules(entry: DataFrame, rules: DataFrame, auxiliary: DataFrame) -> DataFrame:
    """Rules (rx, property, value, type_constraint) whose pattern a description has
    give identifiers that aren't noted yet. A regex has no key, so the rules, a
    table that people write, are tried on every row; up to RULES of them are sent
    to every executor, beyond that it is the planner's choice."""
    if rules.limit(RULES + 1).count() <= RULES:
        rules = F.broadcast(rules)
    hit = F.rlike(F.lower("ext_desc"), F.col("rx")) & ((F.col("type_constraint") == "") | (F.col("type_constraint") == F.col("type")))
    made = entry.join(rules, hit).select(F.col("id").alias("entry_id"), F.col("property").alias("aux_p"), F.col("value").alias("aux_name")).distinct()
    return made.join(auxiliary, ["entry_id", "aux_p", "aux_name"], "left_anti")
