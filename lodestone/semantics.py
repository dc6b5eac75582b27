"""The match state of an entry and the rules that protect it, as Columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Users whose matches are made by an algorithm; only AUTO's are preliminary.
AUTO, BY_DATE, BY_IDENTIFIER, BY_LOCATION = 0, 3, 4, 5
ALGORITHMS = (AUTO, BY_DATE, BY_IDENTIFIER, BY_LOCATION)
BUCKETS = ("noq", "autoq", "na", "nowd", "manual")


def col(name: str, alias: str | None = None) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def unmatched(alias: str | None = None) -> Column:
    return col("q", alias).isNull()


def preliminary(alias: str | None = None) -> Column:
    return (col("q", alias) > 0) & (col("uid", alias) == AUTO)


def full(alias: str | None = None) -> Column:
    return (col("q", alias) > 0) & (col("uid", alias) > 0)


def not_full(alias: str | None = None) -> Column:
    """The complement that a matcher may work on: unmatched or preliminary."""
    return unmatched(alias) | (col("uid", alias) == AUTO)


def match_state(want_unmatched: bool = False, want_preliminary: bool = False, want_full: bool = False, alias: str | None = None) -> Column:
    """Any of the wanted states; none wanted means no restriction."""
    wanted = [f(alias) for f, on in ((unmatched, want_unmatched), (preliminary, want_preliminary), (full, want_full)) if on]
    return reduce(or_, wanted) if wanted else F.lit(True)


def bucket(alias: str | None = None) -> Column:
    """The overview bucket of an entry; the first that applies."""
    q, uid = col("q", alias), col("uid", alias)
    return (
        F.when(uid.isNull() | q.isNull(), "noq").when(uid == AUTO, "autoq").when(q == 0, "na").when(q == -1, "nowd").when(uid > 0, "manual").otherwise("noq")
    )


def bucket_predicates(alias: str | None = None) -> dict[str, Column]:
    """The buckets as predicates that a refresh counts; an entry can be in two."""
    q, uid = col("q", alias), col("uid", alias)
    return {"noq": q.isNull(), "autoq": uid == AUTO, "na": q == 0, "nowd": q == -1, "manual": full(alias)}


def may_write(new_uid: Column, new_q: Column, alias: str | None = None) -> Column:
    """Whether a match may replace what is there: never the same one again, and an
    algorithm only an unmatched or preliminary one."""
    same = col("q", alias).eqNullSafe(new_q) & col("uid", alias).eqNullSafe(new_uid)
    open_ = unmatched(alias) | preliminary(alias)
    return ~same & (~new_uid.isin(*ALGORITHMS) | open_)


def name_key(column: Column) -> Column:
    """Names are equal regardless of case and of blanks at the end."""
    return F.lower(F.rtrim(column))


def entry_type(column: Column) -> Column:
    kind = F.trim(column)
    return F.when(F.lower(kind) == "person", "Q5").when(kind.rlike("^[Qq][0-9]+$"), F.upper(kind)).otherwise("")
