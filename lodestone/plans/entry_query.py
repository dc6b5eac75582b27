"""Composable filters over entries; each becomes a pushed predicate or a semi-join."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import text


@dataclass(frozen=True)
class EntryQuery:
    catalog: int | None = None
    type: str | None = None
    name_regexp: str | None = None
    min_dates: int = 0
    min_aux: int = 0
    state: tuple[bool, bool, bool] = (False, False, False)
    description: bool = False
    coordinates: bool = False
    hint: str | None = None
    ext_ids: tuple[str, ...] = ()
    limit: int | None = None
    offset: int = 0

    def with_(self, **changes) -> EntryQuery:
        return replace(self, **changes)

    def run(self, entry: DataFrame, person_dates: DataFrame, auxiliary: DataFrame, location: DataFrame) -> DataFrame:
        if self.min_dates > 2:
            raise ValueError("an entry has two dates")
        if self.ext_ids and self.catalog is None:
            raise ValueError("external ids need a catalog")
        df = entry.where(S.match_state(*self.state))
        if self.catalog is not None:
            df = df.where(F.col("catalog") == self.catalog)
        if self.type is not None:
            df = df.where(F.col("type") == self.type)
        if self.name_regexp is not None:
            df = df.where(F.col("ext_name").rlike(f"(?i){self.name_regexp}"))
        if self.description:
            df = df.where("ext_desc <> ''")
        if self.hint is not None:
            df = df.where(F.lower("ext_desc").contains(self.hint.lower()))
        if self.ext_ids:
            df = df.where(F.col("ext_id").isin(*self.ext_ids))
        if self.min_dates:
            born, died = F.col("year_born") != "", F.col("year_died") != ""
            dated = person_dates.where(born | died if self.min_dates == 1 else born & died)
            df = df.join(dated.select(F.col("entry_id").alias("id")), "id", "left_semi")
        if self.min_aux:
            enough = auxiliary.groupBy("entry_id").count().where(F.col("count") >= self.min_aux)
            df = df.join(enough.select(F.col("entry_id").alias("id")), "id", "left_semi")
        if self.coordinates:
            df = df.join(location.select(F.col("entry_id").alias("id")), "id", "left_semi")
        if self.limit is not None:
            df = df.orderBy("id").offset(self.offset).limit(self.limit)
        return df


@dataclass(frozen=True)
class Search:
    """All words in the name, or in the name or description."""

    words: tuple[str, ...]
    descriptions: bool = False
    matched: bool | None = None
    exclude: tuple[int, ...] = ()
    include: tuple[int, ...] = ()
    limit: int = 100

    def run(self, entry: DataFrame, catalog: DataFrame) -> DataFrame:
        found = text.has_all_words(F.col("ext_name"), list(self.words))
        if self.descriptions:
            found = found | text.has_all_words(F.col("ext_desc"), list(self.words))
        active = catalog.where("active = 1").select(F.col("id").alias("catalog"))
        df = entry.where(found)
        if self.matched is not None:
            df = df.where(F.col("q") > 0 if self.matched else F.col("q").isNull())
        if self.exclude:
            df = df.where(~F.col("catalog").isin(*self.exclude))
        if self.include:
            df = df.where(F.col("catalog").isin(*self.include))
        return df.join(active, "catalog", "left_semi").orderBy("id").limit(self.limit)


@dataclass(frozen=True)
class Listing:
    """A catalog's entries by what to show. `multiple` stands alone; otherwise each
    state that isn't wanted is taken away."""

    catalog: int
    show_noq: bool = True
    show_autoq: bool = True
    show_userq: bool = True
    show_na: bool = True
    show_nowd: bool = True
    multiple: bool = False
    type: str | None = None
    title: str | None = None
    user: int | None = None

    def run(self, entry: DataFrame, multi_match: DataFrame) -> DataFrame:
        df = entry.where(F.col("catalog") == self.catalog)
        if self.multiple:
            listed = multi_match.select(F.col("entry_id").alias("id"))
            df = df.where(F.col("q").isNull() | (F.col("uid") == 0)).join(listed, "id", "left_semi")
        else:
            states = {"noq": self.show_noq, "autoq": self.show_autoq, "manual": self.show_userq, "na": self.show_na, "nowd": self.show_nowd}
            df = df.where(S.bucket().isin(*[k for k, on in states.items() if on]))
        if self.type is not None:
            df = df.where(F.col("type") == self.type)
        if self.title is not None:
            df = df.where(F.lower("ext_name").contains(self.title.lower()))
        if self.user is not None:
            df = df.where(F.col("uid") == self.user)
        return df


@dataclass(frozen=True)
class Download:
    """A table of entries with the columns and rows that are asked for."""

    catalogs: tuple[int, ...]
    ext_url: bool = False
    dates: bool = False
    location: bool = False
    user: bool = False
    hide: tuple[str, ...] = ()  # of: any_matched, firmly_matched, user_matched, unmatched, no_multiple, name_date_matched, automatched, aux_matched

    def run(self, entry: DataFrame, users: DataFrame, person_dates: DataFrame, location: DataFrame, multi_match: DataFrame) -> DataFrame:
        df = entry.where(F.col("catalog").isin(*self.catalogs))
        q, uid = F.col("q"), F.col("uid")
        rules = {
            "any_matched": q.isNull(), "firmly_matched": q.isNull() | (uid == 0), "user_matched": uid.isNull() | uid.isin(0, 3, 4),
            "unmatched": q.isNotNull(), "name_date_matched": uid != 3, "automatched": uid != 0, "aux_matched": uid != 4,
        }
        for rule in self.hide:
            if rule in rules:
                df = df.where(rules[rule])
        if "no_multiple" in self.hide:
            df = df.join(multi_match.select(F.col("entry_id").alias("id")), "id", "left_semi")
        columns = [F.col("id").alias("entry_id"), "catalog", F.col("ext_id").alias("external_id"), "q", F.col("ext_name").alias("name"), F.col("type").alias("entry_type")]
        if self.ext_url:
            columns.append("ext_url")
        if self.user:
            names = users.select(F.col("id").alias("uid"), F.col("name").alias("matched_by"))
            df, columns = df.join(names, "uid", "left"), [*columns, "matched_by"]
        if self.dates:
            lives = person_dates.select(F.col("entry_id").alias("id"), "born", "died")
            df, columns = df.join(lives, "id", "left"), [*columns, "born", "died"]
        if self.location:
            places = location.select(F.col("entry_id").alias("id"), "lat", "lon")
            df, columns = df.join(places, "id", "left"), [*columns, "lat", "lon"]
        return df.select(*columns)
