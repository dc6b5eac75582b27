"""Delimited files to entries, by a column map and regex columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.functions import dates, text

SEPARATORS = {"CSV": ",", "TSV": "\t", "SSV": ";"}
_PLAIN = ("id", "name", "desc", "url", "q", "autoq", "type", "born", "died")


@dataclass(frozen=True)
class TabularSource:
    """columns: labels by position, empty to skip. A label is one of id, name,
    desc, url, q, autoq, type, born, died, P<property>, A<language>, D<language>.
    patterns: (label, column number, regex) whose first group is one more cell."""

    catalog: int
    columns: tuple[str, ...]
    format: str = "TSV"
    skip_rows: int = 0
    min_columns: int = 1
    url_pattern: str | None = None
    default_type: str = ""
    patterns: tuple[tuple[str, int, str], ...] = field(default=())

    def __post_init__(self) -> None:
        for label in [c for c in self.columns if c] + [p[0] for p in self.patterns]:
            if label not in _PLAIN and not re.fullmatch(r"P\d+|[AD][a-z-]{2,}", label):
                raise ValueError(f"unknown column: {label}")
        if not {"id", "name"} <= set(self.columns):
            raise ValueError("columns id and name are needed")

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Rows as they are in the file: _line and _c0... as text. Short rows are
        filled with nulls and long ones cut, so the schema is fixed beforehand."""
        schema = ", ".join(f"_c{i} string" for i in range(len(self.columns)))
        rows = spark.read.schema(schema).option("sep", SEPARATORS[self.format]).option("mode", "PERMISSIVE").csv(path)
        first = F.regexp_replace("_c0", "^﻿", "")
        rows = rows.withColumn("_c0", first)
        if self.skip_rows:  # header rows: the first of each file, in its first block
            rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
            nth = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
            head = rows.where("_block = 0").select("_file", "_at").withColumn("_nth", nth).where(F.col("_nth") <= self.skip_rows)
            rows = rows.join(head.select("_at"), "_at", "left_anti").drop("_file", "_block", "_at")
        if self.min_columns > 1:
            rows = rows.where(F.col(f"_c{self.min_columns - 1}").isNotNull())
        return rows

    def _cells(self) -> dict[str, Column]:
        cells = {label: F.col(f"_c{i}") for i, label in enumerate(self.columns) if label}
        for label, at, pattern in self.patterns:
            found = F.regexp_extract(F.concat(F.lit("|"), F.col(f"_c{at}"), F.lit("|")), pattern, 1)
            cells[label] = F.nullif(found, F.lit(""))
        return cells

    def entries(self, rows: DataFrame) -> DataFrame:
        """One row for each line with an id and a name: entry columns, born, died,
        auxiliary, aliases and descriptions as arrays. An item given counts as
        found by an identifier, one given as automatic as preliminary."""
        cells = self._cells()
        cell = lambda label: F.trim(cells[label]) if label in cells else F.lit(None).cast("string")
        url = F.coalesce(cell("url"), F.lit(""))
        if self.url_pattern is not None:
            url = text.url_from_pattern(url, F.lit(self.url_pattern), cell("id"))
        sure, guess = text.numeric_item(cell("q")), text.numeric_item(cell("autoq"))
        day = lambda label: F.when(cell(label).rlike(r"^(\d{3,}|\d+-\d{1,2}|\d+-\d{1,2}-\d{1,2})$"), dates.canonical(cell(label)))

        def keyed(k: Column, key: str, value: str):
            return lambda v: F.struct(k.alias(key), v.alias(value))

        def spread(prefix: str, key: str, value: str, number: bool) -> Column:
            parts = []
            for label, c in cells.items():
                if label not in _PLAIN and label[0] == prefix:
                    k = F.lit(int(label[1:])).cast("long") if number else F.lit(label[1:])
                    values = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda v: F.trim(v)), lambda v: v != "")
                    parts.append(F.transform(values, keyed(k, key, value)))
            kind = "long" if number else "string"
            return F.concat(*parts) if parts else F.array().cast(f"array<struct<{key}:{kind},{value}:string>>")

        kind = S.entry_type(F.coalesce(F.nullif(cell("type"), F.lit("")), F.lit(self.default_type)))
        return rows.where(F.coalesce(cell("id"), F.lit("")) != "").where(F.coalesce(cell("name"), F.lit("")) != "").select(
            F.lit(self.catalog).cast("long").alias("catalog"),
            cell("id").alias("ext_id"),
            url.alias("ext_url"),
            F.substring(cell("name"), 1, 127).alias("ext_name"),
            F.substring(F.coalesce(cell("desc"), F.lit("")), 1, 254).alias("ext_desc"),
            F.coalesce(sure, guess).alias("q"),
            F.when(sure.isNotNull(), S.BY_IDENTIFIER).when(guess.isNotNull(), S.AUTO).cast("long").alias("uid"),
            kind.alias("type"),
            day("born").alias("born"),
            day("died").alias("died"),
            spread("P", "prop_numeric", "value", True).alias("auxiliary"),
            spread("A", "language", "value", False).alias("aliases"),
            spread("D", "language", "value", False).alias("descriptions"),
        )

    def counts(self, rows: DataFrame) -> DataFrame:
        """total, with_id, errors: rows that aren't valid UTF-8 are errors and count
        nowhere else. How many cells a row has is no error."""
        at = self.columns.index("id")
        bad = F.concat_ws("", *[f"_c{i}" for i in range(len(self.columns))]).contains("\ufffd")
        return rows.agg(
            F.count_if(~bad).alias("total"), F.count_if(~bad & (F.trim(F.coalesce(F.col(f"_c{at}"), F.lit(""))) != "")).alias("with_id"), F.count_if(bad).alias("errors")
        )


def preview(spark: SparkSession, path: str, format_: str = "TSV", rows: int = 5) -> DataFrame:
    """nth, cells of the header (0) and the first rows of a file, before its columns are
    mapped: a report of rows + 1 lines."""
    found = spark.read.option("sep", SEPARATORS[format_]).option("mode", "PERMISSIVE").csv(path)
    cells = F.array(*[F.coalesce(F.regexp_replace(c, "^\ufeff", ""), F.lit("")) for c in found.columns])
    head = found.withColumn("at", F.monotonically_increasing_id()).select("at", cells.alias("cells")).orderBy("at").limit(rows + 1)
    return head.select((F.row_number().over(Window.orderBy("at")) - 1).alias("nth"), "cells")
