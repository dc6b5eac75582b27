"""Partial dates as text: [-]Y, [-]Y-MM, [-]Y-MM-DD."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = "^(-?[0-9]+)(?:-([0-9]{1,2}))?(?:-([0-9]{1,2}))?$"
# Months by the first three letters of their names, and by whole
# names where these don't tell.
PREFIXES = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "avr": 4, "may": 5, "mai": 5, "mei": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10,
    "nov": 11, "dec": 12, "dez": 12, "dic": 12,
}
NAMES = {
    1: "enero janvier gennaio januari janeiro", 2: "febrero février fevrier febbraio februari fevereiro", 3: "marzo mars märz maerz maart março marco",
    4: "abril avril aprile", 5: "mayo maggio maio mag", 6: "junio juin giugno juni junho", 7: "julio juillet luglio juli julho",
    8: "agosto août aout augustus", 9: "septiembre septembre settembre september setembro", 10: "octubre octobre ottobre oktober outubro",
    11: "noviembre novembre november novembro", 12: "diciembre décembre decembre dicembre dezember dezembro",
}


def _part(column: Column, k: int) -> Column:
    return F.nullif(F.regexp_extract(column, _DATE, k), F.lit("")).try_cast("int")


def parse(column: Column) -> Column:
    """struct(year, month, day), null unless a date; months 1-12, days 1-31."""
    y, m, d = (_part(column, k) for k in (1, 2, 3))
    ok = column.rlike(_DATE) & F.coalesce(m.between(1, 12), F.lit(True)) & F.coalesce(d.between(1, 31), F.lit(True))
    return F.when(ok, F.struct(y.alias("year"), m.alias("month"), d.alias("day")))


def precision(column: Column) -> Column:
    """9 a year, 10 a month, 11 a day."""
    p = parse(column)
    return F.when(p.isNull(), None).when(p["month"].isNull(), 9).when(p["day"].isNull(), 10).otherwise(11)


def canonical(column: Column) -> Column:
    p = parse(column)
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", p["year"].cast("string"), pad(p["month"]), pad(p["day"]))


def wire_time(column: Column) -> Column:
    """+Y-MM-DDT00:00:00Z with 01 for what is missing."""
    p = parse(column)
    pad = lambda c: F.lpad(F.coalesce(c, F.lit(0)).cast("string"), 2, "0")
    sign = F.when(p["year"] < 0, "-").otherwise("+")
    return F.concat(sign, F.abs(p["year"]).cast("string"), F.lit("-"), pad(p["month"]), F.lit("-"), pad(p["day"]), F.lit("T00:00:00Z"))


_WIRE = "^([+-][0-9]+-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z)/([0-9]+)$"


def parse_wire(column: Column) -> Column:
    """struct(time, precision) of +Y-MM-DDThh:mm:ssZ/p; null without a precision up to 14."""
    p = F.nullif(F.regexp_extract(column, _WIRE, 2), F.lit("")).try_cast("int")
    return F.when(p <= 14, F.struct(F.regexp_extract(column, _WIRE, 1).alias("time"), p.alias("precision")))


def from_wire(column: Column) -> Column:
    """The partial date of +Y-MM-DD.../p by its precision: 9 a year, 10 a month, 11 a day."""
    part = lambda k: F.regexp_extract(column, "^\\+([0-9]+)(?:-([0-9]+))?(?:-([0-9]+))?(?:T[^/]*)?/([0-9]+)$", k)
    day = F.when(part(4) == "9", part(1)).when(part(4) == "10", F.concat_ws("-", part(1), part(2))).when(part(4) == "11", F.concat_ws("-", part(1), part(2), part(3)))
    return F.when(parse(day).isNotNull(), canonical(day))


def stamp(column: Column) -> Column:
    """A 14-digit timestamp as RFC 3339 text in UTC; null unless it is one."""
    t = F.try_to_timestamp(column, F.lit("yyyyMMddHHmmss"))
    return F.when(column.rlike("^[0-9]{14}$"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def year(column: Column) -> Column:
    """The leading year as text, empty without one."""
    return F.regexp_extract(column, "^(-*[0-9]+)", 1)


def sane_year(column: Column, this_year: int) -> Column:
    y = F.nullif(F.regexp_extract(column, "([0-9]{3,4})", 1), F.lit("")).try_cast("int")
    return F.when(y.between(0, this_year), y)


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def month_number(column: Column) -> Column:
    name = F.lower(column)
    whole = {w: k for k, words in NAMES.items() for w in words.split()}
    return F.coalesce(_lookup(PREFIXES, F.substring(name, 1, 3)), _lookup(whole, name))


def month_code(column: Column) -> Column:
    """The English three-letter name of a month in any language; else unchanged."""
    names = F.array(*[F.lit(x) for x in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    return F.coalesce(F.get(names, month_number(F.trim(column)) - 1), F.lower(F.trim(column)))


def parse_text(column: Column) -> Column:
    """A year, d.m.y, m.y, or day, month name and year in either order as a
    canonical date; else unchanged but for blanks at the ends."""
    pad = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    text = F.trim(column)
    dmy, my = "^([0-9]{1,2})\\.\\s*([0-9]{1,2})\\.\\s*([0-9]{3,4})$", "^([0-9]{1,2})\\.\\s*([0-9]{3,4})$"
    g = lambda p, k: F.regexp_extract(text, p, k)
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[,.\\s]+", " ")), " ")
    a, b, c = (F.get(words, F.lit(k)) for k in range(3))
    day = lambda w: F.when(w.rlike("^[0-9]{1,2}$") & w.try_cast("int").between(1, 31), w)
    year_ = lambda w: F.when(w.rlike("^[0-9]{1,4}$"), w)
    natural = F.coalesce(
        _joined(pad(year_(c), 4), pad(month_number(b)), pad(day(a))),
        _joined(pad(year_(c), 4), pad(month_number(a)), pad(day(b))),
        F.when(F.size(words) == 2, _joined(pad(year_(b), 4), pad(month_number(a)))),
    )
    return (
        F.when(text.rlike("^[0-9]{1,4}$"), pad(text, 4))
        .when(text.rlike(dmy), _joined(pad(g(dmy, 3), 4), pad(g(dmy, 2)), pad(g(dmy, 1))))
        .when(text.rlike(my), _joined(pad(g(my, 2), 4), pad(g(my, 1))))
        .otherwise(F.coalesce(natural, text))
    )


def _joined(*parts: Column) -> Column:
    """Null if a part is."""
    dashed = [x for p in parts for x in (F.lit("-"), p)][1:]
    return F.concat(*dashed)


def plausible_life(born: Column, died: Column) -> Column:
    """No equal years, no death before birth, at most 120 years, none after 2050."""
    b, d = year(born).try_cast("int"), year(died).try_cast("int")
    both = b.isNotNull() & d.isNotNull()
    return ~(F.coalesce(b > 2050, F.lit(False)) | F.coalesce(d > 2050, F.lit(False)) | F.coalesce(both & ((b >= d) | (d - b > 120)), F.lit(False)))
