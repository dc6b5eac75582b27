"""Keyed writes as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import semantics as S


def first_of(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: list | None = None) -> DataFrame:
    """New rows replace those of the same key. Of several new rows of a key the first
    in the order stays; without one, the largest by its other columns in turn."""
    rest = [F.desc_nulls_last(c) for c in new.columns if c not in key]
    fresh = first_of(new, key, order or rest or [F.lit(1)])
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def numbered(new: DataFrame, table: DataFrame, order: list, id_: str = "id") -> DataFrame:
    """New rows with ids that follow the largest of the table, in the order. For
    tables that people and programs add to row by row: their new rows fit a task."""
    last = table.agg(F.coalesce(F.max(id_), F.lit(0)).alias("_last"))
    ranked = new.drop(id_).withColumn("_rn", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(last))  # one row
    return ranked.withColumn(id_, (F.col("_last") + F.col("_rn")).cast("long")).drop("_last", "_rn")


def insert_ignore(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key isn't there yet, one for each key."""
    fresh = new.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], entry_ids: DataFrame) -> dict[str, DataFrame]:
    """Entries and all their satellites without the given ids (column entry_id)."""
    out = {n: delete(t, entry_ids, ["entry_id"]) for n, t in tables.items() if "entry_id" in t.columns}
    out["entry"] = delete(tables["entry"], entry_ids.withColumnRenamed("entry_id", "id"), ["id"])
    return {**tables, **out}


def set_columns(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def cut_text(entry: DataFrame) -> DataFrame:
    """Names hold 127 characters, descriptions 254, types only items."""
    return entry.withColumns(
        {"ext_name": F.substring("ext_name", 1, 127), "ext_desc": F.substring("ext_desc", 1, 254), "type": S.entry_type(F.col("type"))}
    )


def dated(person_dates: DataFrame) -> DataFrame:
    """With the years that follow from the dates."""
    year = lambda c: F.regexp_extract(c, "^(-*[0-9]+)", 1)
    return person_dates.withColumns({"year_born": year("born"), "year_died": year("died")})
