"""Candidates to decisions, and decisions to tables, under the rules that protect matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import semantics as S
from lodestone.operators.store import first_of, insert_ignore, upsert

#: Candidates that an entry lists at most; with more, it lists none.
LISTED = 10


def unique_or_issue(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, issues): a single candidate is a match, several are a duplicate."""
    matches = found.where(F.size("candidates") == 1).select("entry_id", F.element_at("candidates", 1).alias("q"))
    text = F.to_json(F.transform("candidates", lambda q: F.concat(F.lit("Q"), q.cast("string"))))
    issues = found.where(F.size("candidates") > 1).select("entry_id", F.lit("WD_DUPLICATE").alias("type"), text.alias("json"))
    return matches, issues


def first_and_list(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, multi_match): the first candidate is a preliminary match, and the
    whole list is kept if there are two to LISTED of them."""
    matches = found.where(F.size("candidates") > 0).select("entry_id", F.element_at("candidates", 1).alias("q"))
    n = F.size("candidates")
    lists = found.where(n.between(2, LISTED)).select(
        "entry_id", F.array_join(F.transform("candidates", lambda q: q.cast("string")), ",").alias("candidates"), n.cast("int").alias("candidate_count")
    )
    return matches, lists


def one_decision(decisions: DataFrame) -> DataFrame:
    """entry_id, q, uid, priority: of several decisions for an entry the one of
    lowest priority number, then the smallest item."""
    return first_of(decisions, ["entry_id"], [F.col("priority"), F.col("q")])


def accepted(entry: DataFrame, decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Decisions (entry_id, q, uid) that may be written. Algorithms leave full
    matches alone; the automatic one also what a log row on the entry, with this
    item or none, speaks against."""
    new = decisions.select(F.col("entry_id").alias("id"), F.col("q").alias("new_q"), F.col("uid").alias("new_uid"))
    both = new.join(entry, "id").where(S.may_write(F.col("new_uid"), F.col("new_q")))
    whole = log.where("q IS NULL").select(F.col("entry_id").alias("id")).distinct()
    single = log.where("q IS NOT NULL").select(F.col("entry_id").alias("id"), F.col("q").alias("new_q")).distinct()
    auto = both.where("new_uid = 0").join(whole, "id", "left_anti").join(single, ["id", "new_q"], "left_anti")
    return auto.select("id", "new_q", "new_uid").unionByName(both.where("new_uid <> 0").select("id", "new_q", "new_uid"))


def apply_matches(entry: DataFrame, decisions: DataFrame, log: DataFrame, now: str) -> DataFrame:
    """entry with the accepted decisions written."""
    new = accepted(entry, decisions, log)
    hit = F.col("new_uid").isNotNull()
    out = entry.join(new, "id", "left")
    for c, v in (("q", F.col("new_q")), ("uid", F.col("new_uid")), ("ts", F.lit(now))):
        out = out.withColumn(c, F.when(hit, v).otherwise(F.col(c)))
    return out.select(*entry.columns)


def unmatch(entry: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(entry, log rows): the triple goes; only a full match leaves a log row."""
    gone = where & F.col("q").isNotNull()
    rows = entry.where(where & S.full()).select(F.lit("remove_q").alias("action"), F.col("id").alias("entry_id"), "uid", "q")
    out = entry
    for c in ("q", "uid", "ts"):
        out = out.withColumn(f"_{c}", F.when(gone, F.lit(None)).otherwise(F.col(c)))
    out = out.drop("q", "uid", "ts").withColumnsRenamed({"_q": "q", "_uid": "uid", "_ts": "ts"})
    return out.select(*entry.columns), rows


def purge_automatches(entry: DataFrame, multi_match: DataFrame, catalog: int) -> tuple[DataFrame, DataFrame]:
    """Preliminary matches and candidate lists of a catalog go."""
    out, _ = unmatch(entry, (F.col("catalog") == catalog) & (F.col("uid") == 0))
    return out, multi_match.where(F.col("catalog") != catalog)


def write_lists(multi_match: DataFrame, lists: DataFrame, entry: DataFrame) -> DataFrame:
    new = lists.join(entry.select(F.col("id").alias("entry_id"), "catalog"), "entry_id")
    return upsert(multi_match, new, ["entry_id"])


def write_issues(issues: DataFrame, new: DataFrame, entry: DataFrame) -> DataFrame:
    """Needs an entry; one issue of a type for each."""
    known = new.join(entry.select(F.col("id").alias("entry_id"), "catalog"), "entry_id").withColumn("status", F.lit("OPEN"))
    return insert_ignore(issues, known, ["entry_id", "type"])


def after_match(entry: DataFrame, matched: DataFrame, wd_matches: DataFrame, multi_match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wd_matches, multi_match) after entries (id, new_uid) were matched: their
    status is unknown again, and human matches need no candidates any more."""
    status = matched.select(F.col("id").alias("entry_id"), F.lit("UNKNOWN").alias("status")).join(entry.select(F.col("id").alias("entry_id"), "catalog"), "entry_id")
    settled = matched.where("new_uid <> 0").select(F.col("id").alias("entry_id"))
    return upsert(wd_matches, status, ["entry_id"]), multi_match.join(settled, "entry_id", "left_anti")


def by_external_id(entry: DataFrame, asked: DataFrame, catalog: int, uid: int) -> tuple[DataFrame, DataFrame]:
    """(decisions, misses) for asked (ext_id, q) in a catalog."""
    own = entry.where(F.col("catalog") == catalog).select("ext_id", F.col("id").alias("entry_id"))
    decided = asked.join(own, "ext_id").select("entry_id", "q", F.lit(uid).cast("long").alias("uid"))
    return decided, asked.join(own, "ext_id", "left_anti")


def parse_suggestions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ext_id, q; bad lines) of lines (value) like `id|Q5`; blank ones count for neither."""
    rows = lines.select(F.trim("value").alias("value")).where("value <> ''").withColumn("cells", F.split("value", r"\|"))
    digits = F.regexp_replace(F.col("cells")[1], "[^0-9]", "")
    good = rows.where(F.size("cells") == 2).select(F.trim(F.col("cells")[0]).alias("ext_id"), F.coalesce(digits.try_cast("bigint"), F.lit(0)).alias("q"))
    return good, rows.where(F.size("cells") != 2).select("value")


def suggest(entry: DataFrame, lines: DataFrame, catalog: int, now: str, overwrite: bool = False) -> DataFrame:
    """entry with the suggested items as preliminary matches of unmatched entries, or
    also in place of preliminary ones. Of several for an entry the largest counts."""
    good, _ = parse_suggestions(lines)
    best = good.groupBy("ext_id").agg(F.max("q").alias("_q")).withColumn("catalog", F.lit(catalog).cast("long"))
    open_ = S.not_full() if overwrite else S.unmatched()
    both = entry.join(best, ["catalog", "ext_id"], "left")
    new = {"q": F.col("_q"), "uid": F.lit(S.AUTO).cast("long"), "ts": F.lit(now)}
    return both.select(*[F.when(F.col("_q").isNotNull() & open_, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in entry.columns])


def judged(entry: DataFrame, actions: DataFrame, log: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(entry, log rows) after people judged entries; actions: entry_id, decision, uid.
    yes confirms the item that is there, no takes it away, n_a says there is none."""
    asked = actions.join(entry.select(F.col("id").alias("entry_id"), F.col("q").alias("_q")), "entry_id")
    yes = asked.where("decision = 'yes' AND _q IS NOT NULL").select("entry_id", F.col("_q").alias("q"), "uid")
    none = asked.where("decision = 'n_a'").select("entry_id", F.lit(-1).cast("long").alias("q"), "uid")
    written = apply_matches(entry, yes.unionByName(none), log, now)
    away = asked.where("decision = 'no'").select(F.col("entry_id").alias("id")).distinct().withColumn("_no", F.lit(True))
    marked = written.join(away, "id", "left").withColumn("_no", F.coalesce("_no", F.lit(False)))
    out, rows = unmatch(marked, F.col("_no"))
    return out.select(*entry.columns), rows


def remove_item(entry: DataFrame, catalog: int, q: int) -> DataFrame:
    """A catalog's preliminary matches to an item go."""
    return unmatch(entry, (F.col("catalog") == catalog) & (F.col("uid") == 0) & (F.col("q") == q))[0]


def assign_text(statement_text: DataFrame, auxiliary: DataFrame, entry: DataFrame, catalog: int, prop: int, text: str, q: int) -> tuple[DataFrame, DataFrame]:
    """(statement_text, auxiliary): an item for a text of a property in a catalog, where
    none was chosen; its entries get the item as an identifier."""
    own = entry.where(F.col("catalog") == catalog).select(F.col("id").alias("entry_id")).withColumn("_own", F.lit(True))
    here = F.coalesce("_own", F.lit(False)) & (F.col("property") == prop) & (F.col("text") == text)
    marked = statement_text.join(own, "entry_id", "left")
    texts = marked.withColumn("q", F.when(here & F.col("q").isNull(), q).otherwise(F.col("q"))).withColumn("_hit", here & (F.col("q") == q))
    noted = texts.where("_hit").select("entry_id", F.lit(prop).cast("long").alias("aux_p"), F.lit(f"Q{q}").alias("aux_name"), F.lit(0).alias("in_wikidata"), F.lit(0).alias("entry_is_matched"))
    return texts.select(*statement_text.columns), insert_ignore(auxiliary, noted, ["entry_id", "aux_p", "aux_name"])
