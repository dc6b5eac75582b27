"""Tables as lines of text: TSV, JSON rows, feeds and wiki reports.

Each gives a DataFrame of lines (value), so writing them stays distributed: `write`
puts them into one folder as text files.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.functions.text import scrub_cell, wiki_link

#: Rows of a section up to which a wiki report shows them.
SHOWN = 400


def _line(columns: list[str]) -> Column:
    return F.array_join(F.array(*[scrub_cell(F.col(c).cast("string")) for c in columns]), "\t")


def tsv(df: DataFrame, mark: str = "#") -> DataFrame:
    """A header line, marked, and a line for each row; cells hold no tabs or line ends
    and an absent one is empty."""
    header = df.sparkSession.range(1).select(F.lit(mark + "\t".join(df.columns)).alias("value"))
    return header.unionByName(df.select(_line(df.columns).alias("value")))


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object; absent cells are null."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def changes_feed(changes: DataFrame, entry: DataFrame, base: str) -> DataFrame:
    """title, updated, link of a page of changes (event, entry_id, ts)."""
    names = entry.select(F.col("id").alias("entry_id"), "ext_name")
    what = F.when(F.col("event") == "remove_q", "Match was removed for ").otherwise("New match for ")
    title = F.concat(what, F.lit('"'), F.coalesce("ext_name", F.lit("")), F.lit('"'))
    rows = changes.join(names, "entry_id", "left")
    return rows.select(title.alias("title"), dates.stamp(F.col("ts")).alias("updated"), F.concat(F.lit(f"{base}#/entry/"), F.col("entry_id").cast("string")).alias("link"))


def catalogs_feed(newest: DataFrame, base: str) -> DataFrame:
    """title, updated, link of control.newest_catalogs."""
    return newest.select(F.concat(F.lit("New catalog: "), "name").alias("title"), F.col("created_at").alias("updated"), F.concat(F.lit(f"{base}#/catalog/"), F.col("id").cast("string")).alias("link"))


def atom(rows: list, title: str, base: str, now: str) -> str:
    """An Atom document of a page of feed rows, collected: as many as the page has."""
    entries = "".join(
        f"<entry><id>{escape(r['link'])}</id><title>{escape(r['title'])}</title><updated>{r['updated'] or now}</updated><link rel=\"alternate\" href={quoteattr(r['link'])}/></entry>"
        for r in rows
    )
    return f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><id>{escape(base)}</id><title>{escape(title)}</title><updated>{now}</updated>{entries}</feed>'


def wiki_report(sections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """section, place, value: a wiki page's lines in order. sections: by heading the rows
    (key, value, the line of each) and the table's header; a section of more than
    SHOWN rows becomes one line that says how many, one without rows is left out."""
    out = None
    for k, (heading, (rows, header)) in enumerate(sections.items()):
        few = rows.orderBy("key", "value").limit(SHOWN + 1)  # what decides and what is shown
        counted = rows.agg(F.count("*").alias("n"))  # one row
        marked = few.crossJoin(F.broadcast(counted))
        shown = marked.where(F.col("n") <= SHOWN).select(F.lit(2).alias("part"), "key", "value")
        fixed = lambda part, value, when: counted.where(when).select(F.lit(part).alias("part"), F.lit("").alias("key"), value.alias("value"))
        some, many = (F.col("n") > 0) & (F.col("n") <= SHOWN), F.col("n") > SHOWN
        lines = [
            fixed(0, F.lit(f"== {heading} =="), F.col("n") > 0), fixed(1, F.lit(header), some), shown, fixed(3, F.lit("|}"), some),
            fixed(2, F.concat(F.lit("* "), F.col("n").cast("string"), F.lit(" rows. Too many to show individually.")), many),
        ]
        for piece in lines:
            piece = piece.withColumn("section", F.lit(k))
            out = piece if out is None else out.unionByName(piece)
    return out.select("section", "part", "key", "value")


def unknown_ids(differences: DataFrame, formatter: str = "") -> DataFrame:
    """key, value lines of identifiers that items claim and no entry has."""
    rows = differences.where("kind = 'unknown'")
    return rows.select(F.col("ext_id").alias("key"), F.concat(F.lit("| "), wiki_link(F.col("ext_id"), F.lit(""), formatter), F.lit(" || {{Q|"), F.col("kb_q").cast("string"), F.lit("}}")).alias("value"))


def differing(differences: DataFrame, formatter: str = "") -> DataFrame:
    """key, value lines of entries whose item isn't the one that claims their identifier."""
    rows = differences.where("kind = 'differs'")
    item = lambda c: F.concat(F.lit(" || {{Q|"), F.col(c).cast("string"), F.lit("}}"))
    return rows.select(F.col("ext_id").alias("key"), F.concat(F.lit("| "), wiki_link(F.col("ext_id"), F.lit(""), formatter), item("kb_q"), item("q")).alias("value"))
