"""Commands that scripts and imports give for entries, applied to the tables in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.operators.store import first_of, insert_ignore, upsert

KINDS = ("setAux", "setMatch", "setLocation", "setPersonDates", "setAlias", "setDescription", "setName", "setType")


def split(commands: DataFrame) -> dict[str, DataFrame]:
    """commands: entry_id, seq, kind and the fields property, value, language, q,
    lat, lon, born, died. Of several for one thing the last counts; the result
    holds a table of rows to write for each kind."""
    of = lambda kind: commands.where(F.col("kind") == kind)
    last = lambda df, key: first_of(df, key, [F.desc("seq")])
    return {
        "auxiliary": of("setAux").select("entry_id", F.col("property").alias("aux_p"), F.col("value").alias("aux_name")).distinct(),
        "matches": last(of("setMatch"), ["entry_id"]).select("entry_id", "q"),
        "location": last(of("setLocation"), ["entry_id"]).select("entry_id", "lat", "lon"),
        "person_dates": last(of("setPersonDates"), ["entry_id"]).select("entry_id", "born", "died"),
        "aliases": of("setAlias").select("entry_id", "language", F.col("value").alias("label")).distinct(),
        "descriptions": last(of("setDescription"), ["entry_id", "language"]).select("entry_id", "language", F.col("value").alias("label")),
        "names": last(of("setName"), ["entry_id"]).select("entry_id", F.col("value").alias("ext_name")),
        "types": last(of("setType"), ["entry_id"]).select("entry_id", F.col("value").alias("type")),
    }


def write(tables: dict[str, DataFrame], commands: DataFrame) -> dict[str, DataFrame]:
    """The satellite tables after the commands; matches go through decisions."""
    new = split(commands)
    return {
        **tables,
        "auxiliary": insert_ignore(tables["auxiliary"], new["auxiliary"], ["entry_id", "aux_p", "aux_name"]),
        "location": upsert(tables["location"], new["location"], ["entry_id"]),
        "person_dates": upsert(tables["person_dates"], new["person_dates"], ["entry_id"]),
        "aliases": insert_ignore(tables["aliases"], new["aliases"], ["entry_id", "language", "label"]),
        **({"descriptions": upsert(tables["descriptions"], new["descriptions"], ["entry_id", "language"])} if "descriptions" in tables else {}),
        **({"entry": renamed(tables["entry"], new["names"], new["types"])} if "entry" in tables else {}),
    }


def renamed(entry: DataFrame, names: DataFrame, types: DataFrame) -> DataFrame:
    """entry with new names and types (entry_id and the column), cut and normalised."""
    out = entry
    for table, c in ((names, "ext_name"), (types, "type")):
        value = F.substring(c, 1, 127) if c == "ext_name" else S.entry_type(F.col(c))
        new = table.select(F.col("entry_id").alias("id"), value.alias(f"_{c}"))
        out = out.join(new, "id", "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select(*entry.columns)
