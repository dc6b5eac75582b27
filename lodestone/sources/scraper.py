"""Web pages to entries by regexes: blocks, then entries, then fields by template."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import clean_html, item_from_uri


@dataclass(frozen=True)
class Field:
    """A template with $1.. for the entry's groups, $L1.. for the levels' keys and
    $RID for the row, then (pattern, replacement) pairs."""

    use: str
    rx: tuple[tuple[str, str], ...] = ()


def _groups(n: int) -> Callable[[Column], Column]:
    return lambda row: F.array(*[row[f"g{i}"] for i in range(n)])


@dataclass(frozen=True)
class Scraper:
    rx_entry: tuple[tuple[str, int], ...]  # (pattern, groups); the first that a block matches is used
    fields: dict[str, Field]
    rx_block: str | None = None

    def blocks(self, pages: DataFrame) -> DataFrame:
        """pages: page_id, html and the levels l1, l2, ..."""
        flat = F.regexp_replace("html", "\\s+", " ")
        if self.rx_block is None:
            return pages.withColumn("block", flat).withColumn("block_no", F.lit(0))
        found = F.regexp_extract_all(flat, F.lit(self.rx_block), 1)
        return pages.select("*", F.posexplode(found).alias("block_no", "block"))

    def entries(self, pages: DataFrame) -> DataFrame:
        """page_id, block_no, nth and the fields of every entry found."""
        levels = [c for c in pages.columns if c[0] == "l" and c[1:].isdigit()]
        found = F.array().cast("array<array<string>>")
        for pattern, groups in reversed(self.rx_entry):
            parts = [F.regexp_extract_all("block", F.lit(pattern), g) for g in range(1, groups + 1)]
            rows = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(parts)])
            found = F.when(F.col("block").rlike(pattern), F.transform(rows, _groups(groups))).otherwise(found)
        rows = self.blocks(pages).select("page_id", "block_no", *levels, F.posexplode(found).alias("nth", "groups"))
        return rows.select("page_id", "block_no", "nth", *[self._value(f, levels).alias(n) for n, f in self.fields.items()])

    def analysis(self, pages: DataFrame) -> DataFrame:
        """page_id, blocks and, for each entry pattern, how many entries it gave."""
        blocks = self.blocks(pages)
        open_ = F.lit(True)
        counts = []
        for k, (pattern, _) in enumerate(self.rx_entry, 1):
            here = F.col("block").rlike(pattern)
            counts.append(F.sum(F.when(open_ & here, F.regexp_count("block", F.lit(pattern))).otherwise(0)).alias(f"rx{k}"))
            open_ = open_ & ~here
        return blocks.groupBy("page_id").agg(F.count("*").alias("blocks"), *counts)

    def _value(self, f: Field, levels: list[str]) -> Column:
        out = F.lit(f.use)
        out = reduce(lambda c, name: F.replace(c, F.lit(f"$L{name[1:]}"), F.col(name).cast("string")), levels, out)
        out = F.replace(out, F.lit("$RID"), F.concat_ws("-", "page_id", "block_no", "nth"))
        most = max(g for _, g in self.rx_entry)
        for g in range(most, 0, -1):  # $12 before $1
            out = F.replace(out, F.lit(f"${g}"), F.coalesce(F.get("groups", F.lit(g - 1)), F.lit("")))
        out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), f.rx, out)
        return clean_html(out)


def keys_level(spark: SparkSession, keys: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], f"{name} string")


def range_level(spark: SparkSession, start: int, end: int, step: int, name: str) -> DataFrame:
    return spark.range(start, end + 1, step).select(F.col("id").cast("string").alias(name))


def follow_level(pages: DataFrame, template: str, pattern: str, name: str) -> DataFrame:
    """The outer levels with one more, whose keys a page gives: all first groups of the
    pattern in the page at the template's URL, $1.. standing for the outer keys.
    pages: url, html and the outer levels' columns."""
    outer = [c for c in pages.columns if c not in ("url", "html")]
    url = reduce(lambda c, k: F.replace(c, F.lit(f"${k + 1}"), F.col(outer[k])), range(len(outer)), F.lit(template))
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), 1))
    return pages.where(F.col("url") == url).select(*outer, F.explode(found).alias(name))


def wiki_level(answers: DataFrame, name: str) -> DataFrame:
    """Page titles of a wiki's category or link list; answers: value, its JSON."""
    schema = "query struct<categorymembers:array<struct<title:string>>,allpages:array<struct<title:string>>>"
    found = F.from_json("value", schema)["query"]
    both = F.concat(*[F.coalesce(found[k], F.array()) for k in ("categorymembers", "allpages")])
    return answers.select(F.explode(both).alias("x")).select(F.replace("x.title", F.lit(" "), F.lit("_")).alias(name)).distinct()


def urls(levels: list[DataFrame], template: str) -> DataFrame:
    """All combinations of the levels' keys, as an odometer would run through
    them: a product by definition of the scraper, of lists that it spells out."""
    rows = reduce(lambda a, b: a.crossJoin(b), levels)
    names = [c for df in levels for c in df.columns]
    url = reduce(lambda c, k: F.replace(c, F.lit(f"${k + 1}"), F.col(names[k])), range(len(names)), F.lit(template))
    return rows.withColumn("url", url)


def label_items(answers: DataFrame) -> DataFrame:
    """label, q of SPARQL JSON answers (value) with two variables, whichever of them is
    the URI; rows of other shapes are left out, of equal labels the last counts."""
    cell = "struct<type:string,value:string>"
    schema = f"head struct<vars:array<string>>, results struct<bindings:array<map<string,{cell}>>>"
    rows = answers.select(F.from_json("value", schema).alias("x")).select("x.head.vars", F.posexplode("x.results.bindings").alias("nth", "b"))
    one, two = (F.element_at("b", F.col("vars")[k]) for k in (0, 1))
    swapped = (one["type"] == "uri") & (two["type"] == "literal")
    straight = (two["type"] == "uri") & (one["type"] == "literal")
    uri, label = F.when(swapped, one["value"]).otherwise(two["value"]), F.when(swapped, two["value"]).otherwise(one["value"])
    found = rows.where(swapped | straight).select("nth", label.alias("label"), item_from_uri(uri).alias("q")).where("q IS NOT NULL")
    return found.groupBy("label").agg(F.max_by("q", "nth").alias("q"))


def sparql_tsv(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text lines (value) of a SPARQL TSV answer without its header: <uri> and
    "literal"@lang cells unwrapped."""
    cells = F.split("value", "\t")

    def cell(k: int) -> Column:
        raw = cells[k]
        literal = F.regexp_extract(raw, '^"(.*)"(?:@[A-Za-z-]+|\\^\\^.*)?$', 1)
        plain = F.replace(F.replace(F.replace(literal, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
        return F.when(raw.rlike("^<.*>$"), F.regexp_extract(raw, "^<(.*)>$", 1)).when(raw.startswith('"'), plain).otherwise(raw)

    return rows.select(*[cell(k).alias(c) for k, c in enumerate(columns)])
