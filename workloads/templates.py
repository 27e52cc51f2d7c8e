"""Schema documents and question templates that the given tables fill in.

A customer owns one database of one of four families (`c_custkey % 4`), an
order is one question to it. All texts grow with `orders` and `customer`.
"""

from __future__ import annotations

import json

FAMILIES = ("retail", "corpus", "activity", "field survey/2024")

# Databases that all events ask, and values their questions have.
SHARED_DATABASES, REPEATED_VALUES = 25, 20

# Tables of each family as (table, [(column, type)]).
TABLES = {
    "retail": [
        ("region", [("r_regionkey", "number"), ("r_name", "text")]),
        ("nation", [("n_nationkey", "number"), ("n_name", "text"), ("n_regionkey", "number")]),
        ("customer", [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"),
                      ("c_acctbal", "number"), ("c_mktsegment", "text")]),
        ("supplier", [("s_suppkey", "number"), ("s_name", "text"), ("s_nationkey", "number"),
                      ("s_acctbal", "number")]),
        ("part", [("p_partkey", "number"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"),
                  ("p_size", "number"), ("p_retailprice", "number")]),
        ("orders", [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"),
                    ("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderpriority", "text")]),
        ("lineitem", [("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"),
                      ("l_linenumber", "number"), ("l_quantity", "number"), ("l_extendedprice", "number"),
                      ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"),
                      ("l_linestatus", "text"), ("l_shipdate", "time")]),
    ],
    "corpus": [
        ("documents", [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"),
                       ("n_chars", "number")]),
        ("labels", [("doc_id", "number"), ("quality", "number"), ("toxic", "number")]),
        ("benchmark", [("item_id", "number"), ("text", "text")]),
        ("pages", [("page_id", "number"), ("url", "text"), ("html", "text")]),
        ("embeddings", [("vec_id", "number"), ("embedding", "others"), ("label", "number")]),
    ],
    "activity": [
        ("events", [("event_id", "number"), ("ts", "time"), ("user_id", "number"), ("event_type", "text"),
                    ("value", "number"), ("props", "text")]),
        ("conversations", [("conv_id", "number"), ("turn", "number"), ("role", "text"), ("text", "text")]),
    ],
    "field survey/2024": [
        ("tblSiteVisits", [("SiteVisitID", "number"), ("VisitDate", "time"), ("ObserverID", "number"),
                           ("UTME", "number"), ("UTMN", "number"), ("Obs Count#", "number")]),
        ("tblObservers", [("ObserverID", "number"), ("FirstName", "text"), ("LastName", "text"),
                          ("Organization", "text")]),
        ("tluSpecies", [("SPCODE", "text"), ("CommonName", "text"), ("ScientificName", "text"),
                        ("Genus", "text")]),
        ("tblSightings", [("SightingID", "number"), ("SiteVisitID", "number"), ("SPCODE", "text"),
                          ("x", "number"), ("y", "number"), ("AvgPressure", "number"), ("Notes", "text")]),
    ],
}

PRIMARY_KEYS = {
    "retail": [("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"),
               ("supplier", "s_suppkey"), ("part", "p_partkey"), ("orders", "o_orderkey")],
    "corpus": [("documents", "doc_id"), ("benchmark", "item_id"), ("pages", "page_id"),
               ("embeddings", "vec_id")],
    "activity": [("events", "event_id"), ("conversations", "conv_id")],
    "field survey/2024": [("tblSiteVisits", "SiteVisitID"), ("tblObservers", "ObserverID"),
                          ("tluSpecies", "SPCODE"), ("tblSightings", "SightingID")],
}

FOREIGN_KEYS = {
    "retail": [(("nation", "n_regionkey"), ("region", "r_regionkey")),
               (("customer", "c_nationkey"), ("nation", "n_nationkey")),
               (("supplier", "s_nationkey"), ("nation", "n_nationkey")),
               (("orders", "o_custkey"), ("customer", "c_custkey")),
               (("lineitem", "l_orderkey"), ("orders", "o_orderkey")),
               (("lineitem", "l_partkey"), ("part", "p_partkey")),
               (("lineitem", "l_suppkey"), ("supplier", "s_suppkey"))],
    "corpus": [(("labels", "doc_id"), ("documents", "doc_id"))],
    "activity": [],
    "field survey/2024": [(("tblSiteVisits", "ObserverID"), ("tblObservers", "ObserverID")),
                          (("tblSightings", "SiteVisitID"), ("tblSiteVisits", "SiteVisitID")),
                          (("tblSightings", "SPCODE"), ("tluSpecies", "SPCODE"))],
}

# Types given in each document: with one for `*`, three short, all, one short.
TYPE_LISTS = {
    "retail": lambda types: ["text"] + types,
    "corpus": lambda types: (["text"] + types)[:-3],
    "activity": lambda types: ["text"] + types,
    "field survey/2024": lambda types: types,
}


def document(family: str) -> dict:
    """The schema document of a family."""
    tables = TABLES[family]
    pairs = [[-1, "*"]] + [[i, column] for i, (_, columns) in enumerate(tables) for column, _ in columns]
    place = {}
    for i, (table, columns) in enumerate(tables):
        for column, _ in columns:
            place[table, column] = pairs.index([i, column])
    return {
        "table_names_original": [table for table, _ in tables],
        "column_names_original": pairs,
        "column_types": TYPE_LISTS[family]([kind for _, columns in tables for _, kind in columns]),
        "primary_keys": [place[key] for key in PRIMARY_KEYS[family]],
        "foreign_keys": [[place[a], place[b]] for a, b in FOREIGN_KEYS[family]],
    }


# Templates per family as (question, links, SQL).
TEMPLATES = {
    "retail": [
        ("How many orders were placed in {year}",
         {"orders": ["o_orderdate"]},
         "select count(*) from orders where year(o_orderdate) = {year}"),
        ("List customer name and account balance for market segment {seg}",
         {"customer": ["c_name", "c_acctbal", "c_mktsegment"]},
         "select c_name, c_acctbal from customer where c_mktsegment = '{seg}'"),
        ("Total o_totalprice per customer c_name for priority {prio}",
         {"customer": ["c_custkey", "c_name"], "orders": ["o_custkey", "o_totalprice", "o_orderpriority"]},
         "select c_name, sum(o_totalprice) from customer join orders on c_custkey = o_custkey "
         "where o_orderpriority = '{prio}' group by c_name"),
        ("Show lineitem l_quantity and l_discount of order {key}",
         {"lineitem": ["l_orderkey", "l_quantity", "l_discount"]},
         "select l_quantity, l_discount from lineitem where l_orderkey = {key}"),
        ("Which nation and region does the supplier of order {key} belong to, give the supplier name, "
         "nation name and region name for every lineitem in that order please sorted by name",
         {"lineitem": ["l_orderkey", "l_suppkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
          "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"]},
         "select s_name, n_name, r_name from lineitem join supplier on l_suppkey = s_suppkey "
         "join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey "
         "where l_orderkey = {key} order by s_name"),
        ("How many parts exist", {"part": []}, "select count(*) from part"),
    ],
    "corpus": [
        ("Average n_chars of documents by lang for case {key}",
         {"documents": ["n_chars", "lang"]},
         "select lang, avg(n_chars) from documents group by lang"),
        ("Count toxic labels per document source",
         {"documents": ["doc_id", "source"], "labels": ["doc_id", "toxic"]},
         "select source, count(*) from documents join labels on documents.doc_id = labels.doc_id "
         "where toxic = 1 group by source"),
    ],
    "activity": [
        ("Events of user {key} by month",
         {"events": ["user_id", "ts"]},
         "select month(ts), count(*) from events where user_id = {key} group by month(ts)"),
        ("Which users have purchase events and a maximum value",
         {"events": ["user_id", "event_type", "value"]},
         "select user_id from events where value = (select max(value) from events) "
         "and user_id in (select user_id from events where event_type = 'purchase')"),
    ],
    "field survey/2024": [
        ("What are the easting and northing coordinates of site visits in {year}",
         {"tblSiteVisits": ["UTME", "UTMN", "VisitDate"]},
         "select UTME, UTMN from tblSiteVisits where year(VisitDate) = {year}"),
        ("Common names of species seen by observer last name on visit {key}",
         {"tblObservers": ["ObserverID", "LastName"], "tblSiteVisits": ["SiteVisitID", "ObserverID"],
          "tblSightings": ["SiteVisitID", "SPCODE"], "tluSpecies": ["SPCODE", "CommonName"]},
         "select CommonName from tblSightings join tluSpecies on tblSightings.SPCODE = tluSpecies.SPCODE "
         "join tblSiteVisits on tblSightings.SiteVisitID = tblSiteVisits.SiteVisitID "
         "join tblObservers on tblSiteVisits.ObserverID = tblObservers.ObserverID "
         "where tblSiteVisits.SiteVisitID = {key}"),
    ],
}

RUNS = (1, 2, 3, 4)
# A run that never gave predictions.
FAILED_RUN = 5

# Settings files of runs; run 4 has none. Keys that nobody knows are dropped.
RUN_SETTINGS = {
    1: '{"retrieval": {"max_tables": 2, "max_columns_per_table": 4, "min_columns_per_table": 2, "join_neighbor_limit": 1, "depth": 3}}',
    2: '{"output_format": "NAMES", "retrieval": {"max_tables": 2, "max_columns_per_table": 1, "min_columns_per_table": 4, '
    '"join_neighbor_limit": 1}, "train_config": {"lora_r": 16}}',
    3: '{"base_model": "base-7b", "output_format": "ids", "seed": 7, "retrieval": {"max_tables": 12, "max_columns_per_table": 20, "include_types": null}}',
}

# An answer whose values are not lists of names.
ODD_ANSWER = (
    '{"orders":"o_orderkey","customer":{"c_name":1},"part":null,"lineitem":["l_tax",2,null],'
    '"events":["ts","ts"],"EVENTS":["Value"],"documents":7}'
)


def links_text(links: dict) -> str:
    return json.dumps(links, separators=(",", ":"))


def rows() -> list[tuple[int, int, str, str, str]]:
    """All templates as (family number, number within the family, question, links, SQL)."""
    return [
        (f, i, question, links_text(links), sql)
        for f, family in enumerate(FAMILIES)
        for i, (question, links, sql) in enumerate(TEMPLATES[family])
    ]
