"""Names, descriptions, markup and identifiers as Column expressions."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What names carry besides the name itself.
HONORIFICS = "Sir|Mme|Dr|Mother|Father"
TITLES = "Sir|Baron|Baronesse?|Graf|Gräfin|Prince|Princess|Dr\\.|Prof\\.|Rev\\."
SUFFIXES = "Jr\\.?|Sr\\.?|PhD\\.?|MD|M\\.D\\."
NOBILITY = "Ritter|Freiherr"


def replace_all(column: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, column)


def squeeze(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, "\\s+", " "))


def sanitize_name(column: Column) -> Column:
    """Without form of address, initials before a slash, ampersands and brackets."""
    return squeeze(replace_all(column, [(f"^({HONORIFICS})\\.? ", " "), ("\\b[A-Z]\\. /", " "), (" & ", " "), ("\\(.+?\\)", " ")]))


def simplify_name(column: Column) -> Column:
    """First and last word of a person's name, without titles and suffixes. Titles
    that follow each other go in one match."""
    bare = replace_all(column, [("\\s*\\(.*?\\)\\s*", " "), (f"[, ]+({SUFFIXES})$", " "), (f"\\s*({NOBILITY})\\s+", " ")])
    untitled = F.trim(F.regexp_replace(squeeze(bare), f"^(?:(?:{TITLES})\\s+)+", ""))
    return F.trim(F.regexp_replace(untitled, "^(\\S+) .*?(\\S+)$", "$1 $2"))


def has_initials(column: Column) -> Column:
    return column.rlike("[A-Z]\\.")


def rewrite_taxon_name(column: Column) -> Column:
    """One spelling for subspecies and varieties; a hybrid's sign joins its name."""
    out = F.regexp_replace(F.replace(column, F.lit(" ssp. "), F.lit(" subsp. ")), "^× ", "×")
    return F.replace(F.replace(out, F.lit(" subsp "), F.lit(" subsp. ")), F.lit(" var "), F.lit(" var. "))


def safe_url(column: Column) -> Column:
    """Characters that a URL can't hold, percent-encoded; the others stay."""
    unsafe = [chr(c) for c in (*range(32), 127)] + list(' "<>[\\]^`{|}')
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}")), unsafe, column)


@F.pandas_udf(StringType())  # not its name: that would need a session on import
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities decoded; there are over two thousand, and no SQL function."""
    return texts.map(html.unescape, na_action="ignore")


_COMMON = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "nbsp": "\u00a0", "amp": "&"}  # amp last: one pass decodes once


def decode_entities(column: Column) -> Column:
    """Common entities are decoded in place; only a text with another one goes to
    Python. The condition is in the function's argument, as an argument is computed
    for every row whatever stands around the call."""
    other = column.rlike(f"&(?!(?:{'|'.join(_COMMON)});)[A-Za-z#]")
    plain = reduce(lambda c, e: F.replace(c, F.lit(f"&{e[0]};"), F.lit(e[1])), _COMMON.items(), column)
    return F.coalesce(unescape(F.when(other, column)), plain)


def strip_tags(column: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(column, "&nbsp;", " "), "<[^>]*>", " "))


def clean_html(column: Column) -> Column:
    return F.trim(decode_entities(strip_tags(column)))


def numeric_item(column: Column) -> Column:
    """Q42 -> 42."""
    return F.regexp_extract(column, "([0-9]+)$", 1).try_cast("bigint")


def item_from_uri(column: Column) -> Column:
    return F.regexp_extract(column, "Q([0-9]+)$", 1).try_cast("bigint")


def description_check(old: Column, new: Column) -> Column:
    """Equal, or every number of three or four digits in old is also in new."""
    numbers = F.regexp_extract_all(old, F.lit("([0-9]{3,4})"), 1)
    return (old == new) | ((F.size(numbers) > 0) & F.forall(numbers, lambda n: F.contains(new, n)))


def scrub_cell(column: Column) -> Column:
    """No tabs or line ends in a cell of a text download."""
    return F.translate(F.coalesce(column, F.lit("")), "\t\r\n\u0085\u2028\u2029", "      ")


def words(column: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(column), "[^a-z0-9]+"), lambda w: w != "")


def has_all_words(column: Column, wanted: list[str]) -> Column:
    found = words(column)
    return reduce(lambda a, b: a & b, [F.array_contains(found, w.lower()) for w in wanted], F.lit(True))


def url_from_pattern(url: Column, pattern: Column, ext_id: Column) -> Column:
    return F.when(url == "", F.replace(pattern, F.lit("$1"), ext_id)).otherwise(url)


def formatter_to_regex(template: Column) -> Column:
    """A URL template with $1 as a regex that captures the identifier."""
    escaped = F.regexp_replace(template, "([.?+*()\\[\\]{}^|\\\\])", "\\\\$1")
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(escaped, "^https?", "https?"), F.lit("$1"), F.lit("(.+?)")), F.lit("$"))


def new_description(old: Column, parts: Column) -> Column:
    """The parts before the old description, without tags; the old one alone if
    there are no parts or they say the same."""
    joined = F.array_join(parts, "; ")
    both = F.when(old == "", joined).otherwise(F.concat_ws("; ", joined, old))
    return F.when((F.size(parts) < 1) | (joined == old), old).otherwise(squeeze(F.regexp_replace(both, "<[^>]*>", " ")))


def wiki_link(ext_id: Column, url: Column, formatter: str = "") -> Column:
    """[url id] by the property's URL pattern, else by the entry's own, else the id."""
    if formatter:
        return F.concat(F.lit("["), F.replace(F.lit(formatter), F.lit("$1"), ext_id), F.lit(" "), ext_id, F.lit("]"))
    return F.when(url != "", F.concat(F.lit("["), url, F.lit(" "), ext_id, F.lit("]"))).otherwise(ext_id)


def quoted(column: Column) -> Column:
    """A text as an SQL literal, quotes doubled."""
    return F.concat(F.lit("'"), F.replace(column, F.lit("'"), F.lit("''")), F.lit("'"))


def percent(done: Column, total: Column) -> Column:
    """0 to 100; null without a total."""
    return F.when(total > 0, F.least(F.greatest(done / total * 100, F.lit(0.0)), F.lit(100.0)))


def slug(column: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "_"), "^_|_$", "")


def fix_external_id(prop: Column, value: Column, spaceless: int = 213) -> Column:
    return F.when(prop == spaceless, F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)
