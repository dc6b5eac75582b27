"""Scripts of catalogs, run over their entries.

A script is Python source that defines run(o), or run(o, html) for the kinds that
read pages; o has the entry's fields. It sees the helpers below and a few builtins,
no imports and no files, and a run may execute a bounded number of lines. That
keeps out mistakes, not attackers: only people who may run code on the cluster
may save scripts. A script that fails on an entry gives nothing for it.

Entries go through in Arrow batches; what comes out are rows, which the writers of
`commands` and the guards of `decisions` apply like any others.
"""

from __future__ import annotations

import html as html_
import json
import re
import sys
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import dates
from lodestone.operators import store
from lodestone.plans.workers import put_package_on_path

#: Lines that one run may execute.
LINES = 100_000

FIELDS = ("id", "catalog", "ext_id", "ext_url", "ext_name", "ext_desc", "q", "uid", "type")
COMMANDS = "entry_id long, seq int, kind string, property long, value string, language string, q long, lat double, lon double, born string, died string"
_SAFE = {f.__name__: f for f in (abs, all, any, bool, dict, enumerate, float, int, len, list, max, min, range, reversed, round, set, sorted, str, sum, tuple, zip)}


class TooLong(RuntimeError):
    """A script ran for more lines than it may."""


def _month(word: str) -> int | None:
    """As dates.month_number."""
    name = word.strip().lower()
    if name[:3] in dates.PREFIXES:
        return dates.PREFIXES[name[:3]]
    return next((k for k, words in dates.NAMES.items() if name in words.split()), None)


def ml(word: str) -> str:
    """As dates.month_code."""
    k = _month(word)
    return "jan feb mar apr may jun jul aug sep oct nov dec".split()[k - 1] if k else word.strip().lower()


def dp(value: str) -> str:
    """As dates.parse_text."""
    text = value.strip()
    if re.fullmatch(r"\d{1,4}", text):
        return text.zfill(4)
    if m := re.fullmatch(r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{3,4})", text):
        return f"{m[3].zfill(4)}-{m[2].zfill(2)}-{m[1].zfill(2)}"
    if m := re.fullmatch(r"(\d{1,2})\.\s*(\d{3,4})", text):
        return f"{m[2].zfill(4)}-{m[1].zfill(2)}"
    words = [*re.sub(r"[,.\s]+", " ", text.lower()).strip().split(" "), "", "", ""][:4]
    a, b, c, more = words
    day = lambda w: w.isdigit() and len(w) < 3 and 1 <= int(w) <= 31
    year = lambda w: w.isdigit() and len(w) < 5
    if not more and year(c) and _month(b) and day(a):
        return f"{c.zfill(4)}-{_month(b):02}-{a.zfill(2)}"
    if not more and year(c) and _month(a) and day(b):
        return f"{c.zfill(4)}-{_month(a):02}-{b.zfill(2)}"
    if not c and year(b) and _month(a):
        return f"{b.zfill(4)}-{_month(a):02}"
    return text


def clean_html(value: str) -> str:
    """As text.clean_html."""
    plain = re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", value.replace("&nbsp;", " "))).strip()
    return html_.unescape(plain).strip()


def re_match(pattern: str, value: str) -> list[str]:
    """The groups of the first match, or the whole of it if there are none; else nothing."""
    m = re.search(pattern, value)
    return [] if m is None else [g or "" for g in m.groups()] or [m[0]]


def re_test(pattern: str, value: str) -> bool:
    return re.search(pattern, value) is not None


def re_find_all(pattern: str, value: str) -> list[list[str]]:
    return [[g or "" for g in m.groups()] or [m[0]] for m in re.finditer(pattern, value)]


def re_sub(pattern: str, new: str, value: str) -> str:
    return re.sub(pattern, new, value)


def json_decode(value: str):
    return json.loads(value)


HELPERS = {f.__name__: f for f in (dp, ml, clean_html, re_match, re_test, re_find_all, re_sub, json_decode)}


class _Recorder:
    """Commands in the order in which a script gives them."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def _add(self, kind: str, **fields) -> None:
        self.rows.append({"seq": len(self.rows), "kind": kind, **fields})

    def names(self) -> dict[str, Callable]:
        return {
            "setAux": lambda prop, value: self._add("setAux", property=int(prop), value=str(value)),
            "setMatch": lambda q: self._add("setMatch", q=int(str(q).lstrip("Qq"))),
            "setLocation": lambda lat, lon: self._add("setLocation", lat=float(lat), lon=float(lon)),
            "setPersonDates": lambda born="", died="": self._add("setPersonDates", born=str(born), died=str(died)),
            "setAlias": lambda value, language="": self._add("setAlias", value=str(value), language=language),
            "setDescription": lambda value, language="": self._add("setDescription", value=str(value), language=language),
            "setName": lambda value: self._add("setName", value=str(value)),
            "setType": lambda value: self._add("setType", value=str(value)),
        }


def compiled(code: str) -> Callable:
    """The script as a function of (fields, html) that gives (result, commands). Raises
    SyntaxError if it can't be read, ValueError without a run function."""
    binary = compile(code, "<script>", "exec")

    def limited(f: Callable, *args):
        left = LINES

        def trace(frame, event, arg):
            nonlocal left
            if frame.f_code.co_filename != "<script>":
                return None
            left -= event == "line"
            if left < 0:
                raise TooLong(f"more than {LINES} lines")
            return trace

        before = sys.gettrace()
        sys.settrace(trace)
        try:
            return f(*args)
        finally:
            sys.settrace(before)

    def call(fields: dict, html: str | None = None):
        recorder = _Recorder()
        space = {"__builtins__": _SAFE, **HELPERS, **recorder.names()}
        limited(exec, binary, space)
        if not callable(space.get("run")):
            raise ValueError("the script defines no run(o)")
        args = (SimpleNamespace(**fields),) if html is None else (SimpleNamespace(**fields), html)
        return limited(space["run"], *args), recorder.rows

    return call


def dry_run(code: str, fields: dict, html: str | None = None) -> tuple[object, list[dict]]:
    """One entry, on the driver: the result and the commands; errors come out."""
    return compiled(code)({f: fields.get(f) for f in FIELDS}, html)


def _fields(row: dict) -> dict:
    text = ("ext_id", "ext_url", "ext_name", "ext_desc", "type")
    return {f: (row[f] or "") if f in text else row[f] for f in FIELDS}


def _rows(code: str, make: Callable[[object, list[dict]], list[dict]], schema: str, page: bool) -> Callable:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    shape = pa.schema([(n, types[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = compiled(code)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    result, commands = call(_fields(row), row["html"] if page else None)
                    made = make(result, commands)
                except Exception:  # noqa: BLE001  as documented: an entry on which a script fails gives nothing
                    continue
                out += [{"entry_id": int(row["id"]), **x} for x in made]
            yield pa.RecordBatch.from_pylist(out, shape)

    return run


def _commands(result: object, commands: list[dict]) -> list[dict]:
    return commands


def _dates(result: object, commands: list[dict]) -> list[dict]:
    born, died = (result if isinstance(result, (list, tuple)) else ("", ""))[:2]
    return [{"born": str(born or ""), "died": str(died or "")}] if born or died else []


def _applied(entry: DataFrame, code: str, make: Callable, schema: str, page: bool = False) -> DataFrame:
    compiled(code)  # a script that can't be read fails here
    put_package_on_path(entry.sparkSession)
    return entry.select(*FIELDS, *(["html"] if page else [])).mapInArrow(_rows(code, make, schema, page), schema)


def person_dates(entry: DataFrame, code: str, catalog: int) -> DataFrame:
    """entry_id, born, died that a PERSON_DATE script gives for the catalog's people with
    a description, as far as they make a plausible life."""
    rows = entry.where((F.col("catalog") == catalog) & (F.col("type") == "Q5") & (F.col("ext_desc") != ""))
    found = _applied(rows, code, _dates, "entry_id long, born string, died string")
    for c in ("born", "died"):
        found = found.withColumn(c, F.coalesce(F.when(dates.parse(F.col(c)).isNotNull(), dates.canonical(F.col(c))), F.lit("")))
    return found.where((F.col("born") != "") | (F.col("died") != "")).where(dates.plausible_life(F.col("born"), F.col("died")))


def replace_person_dates(table: DataFrame, entry: DataFrame, code: str, catalog: int) -> DataFrame:
    """person_dates after the script ran: the catalog's dates are cleared first."""
    gone = entry.where(F.col("catalog") == catalog).select(F.col("id").alias("entry_id"))
    return store.delete(table, gone, ["entry_id"]).unionByName(store.dated(person_dates(entry, code, catalog)).select(*table.columns))


def commands_from_description(entry: DataFrame, code: str, catalog: int) -> DataFrame:
    """Commands that an AUX_FROM_DESC script gives for all of the catalog's entries."""
    return _applied(entry.where(F.col("catalog") == catalog), code, _commands, COMMANDS)


def commands_from_pages(entry: DataFrame, pages: DataFrame, code: str, catalog: int) -> DataFrame:
    """Commands that a DESC_FROM_HTML or COORDS_FROM_HTML script gives for the catalog's
    entries and the pages at their URLs (url, html), white space squeezed."""
    found = pages.select(F.col("url").alias("ext_url"), F.regexp_replace("html", "\\s+", " ").alias("html"))
    return _applied(entry.where(F.col("catalog") == catalog).join(found, "ext_url"), code, _commands, COMMANDS, page=True)
