"""Schemas and unique keys of the catalog tables, as DDL strings.

`uid` is the matching user (0 automatic, 3 date, 4 identifier, 5 location, others
human), `q` the matched item: null unmatched, 0 not applicable, -1 no item.
"""

from __future__ import annotations

from typing import NamedTuple


class Table(NamedTuple):
    ddl: str
    key: tuple[str, ...]


TABLES = {
    "entry": Table(
        "id long, catalog long, ext_id string, ext_url string, ext_name string, ext_desc string, q long, uid long, ts string, type string",
        ("catalog", "ext_id"),
    ),
    "catalog": Table(
        "id long, name string, url string, descr string, type string, wd_prop long, wd_qual long, search_wp string, active int, owner long, has_person_date string",
        ("id",),
    ),
    "aliases": Table("entry_id long, language string, label string, added_by_user int", ("language", "label", "entry_id")),
    "descriptions": Table("entry_id long, language string, label string", ("language", "entry_id")),
    "auxiliary": Table(
        "id long, entry_id long, aux_p long, aux_name string, in_wikidata int, entry_is_matched int", ("entry_id", "aux_p", "aux_name")
    ),
    "person_dates": Table("entry_id long, born string, died string, year_born string, year_died string", ("entry_id",)),
    "location": Table("entry_id long, lat double, lon double", ("entry_id",)),
    "kv_entry": Table("entry_id long, kv_key string, kv_value string", ("entry_id", "kv_key", "kv_value")),
    "kv_catalog": Table("catalog_id long, kv_key string, kv_value string", ("catalog_id", "kv_key")),
    "mnm_relation": Table("entry_id long, property long, target_entry_id long", ("entry_id", "property", "target_entry_id")),
    "multi_match": Table("entry_id long, catalog long, candidates string, candidate_count int", ("entry_id",)),
    "statement_text": Table(
        "id long, entry_id long, property long, text string, in_wikidata int, entry_is_matched int, q long", ("entry_id", "property", "text")
    ),
    "issues": Table("id long, entry_id long, type string, json string, status string, catalog long", ("entry_id", "type")),
    "log": Table("id long, action string, entry_id long, uid long, ts string, q long", ("id",)),
    "wd_matches": Table("entry_id long, status string, ts string, catalog long", ("entry_id",)),
    "jobs": Table("id long, action string, catalog long, depends_on long, status string, last_ts string, next_ts string", ("action", "catalog")),
    "users": Table("id long, name string, is_catalog_admin int", ("id",)),
    "kb_terms": Table("text string, q long, language string", ("text", "q", "language")),
    "kb_sitelinks": Table("site string, title string, q long", ("site", "title")),
    "kb_redirects": Table("from_q long, to_q long", ("from_q",)),
    "kb_items": Table("q long", ("q",)),
    "kb_claims": Table("q long, property long, value string", ("q", "property", "value")),
}

#: The nested wire form of an entry with all its satellites.
META_ENTRY = (
    "entry struct<id:long,catalog:long,ext_id:string,ext_url:string,ext_name:string,ext_desc:string,q:long,user:long,timestamp:string,type:string>, "
    "auxiliary array<struct<prop_numeric:long,value:string,in_wikidata:boolean,entry_is_matched:boolean>>, "
    "coordinate struct<lat:double,lon:double,precision:double>, person_dates struct<born:string,died:string>, "
    "descriptions map<string,string>, aliases array<struct<language:string,value:string>>, "
    "mnm_relations array<struct<property:long,target:struct<type:string,entry_id:long,catalog:long,ext_id:string,q:long>>>, "
    "kv_entries array<struct<key:string,value:string>>"
)
