"""Word lists and prompt texts.

Everything in this file is a fixed value: results only agree with published
predictions and scores when these texts are the same, so they are stated
plainly and never computed.
"""

from __future__ import annotations

# Words that never count as evidence.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has",
    "have", "had", "how", "in", "include", "into", "is", "it", "its", "list",
    "many", "me", "more", "most", "no", "not", "number", "of", "on", "one",
    "only", "or", "per", "show", "that", "the", "their", "them", "there",
    "to", "value", "values", "was", "were", "what", "where", "which", "with",
    "without", "all", "each", "display", "give", "get", "make", "return",
)

# Words that stand for one another in questions and schemas.
SYNONYM_GROUPS = (
    ("x", "east", "easting", "utm", "utme", "utmx", "longitude", "long", "lon"),
    ("y", "north", "northing", "utm", "utmn", "utmy", "latitude", "lat"),
    ("date", "year", "month", "day", "time"),
    ("school", "entity", "institution"),
    ("student", "subgroup", "sub", "group"),
    ("absence", "absent", "absenteeism", "chronic"),
    ("rate", "percent", "percentage", "pct"),
    ("count", "total", "number", "num", "cnt"),
    ("name", "title", "description", "text", "descr"),
    ("species", "sp", "spcode", "common", "scientific", "genus"),
    ("location", "loc", "site", "station", "place", "plot"),
    ("event", "record", "entry", "observation", "obs"),
    ("vehicle", "veh", "vehno", "vin", "make", "model"),
    ("crash", "case", "caseid", "accident"),
    ("injury", "injuries", "ais", "severity", "region"),
    ("tire", "tiresize", "tiremodel", "pressure"),
    ("employee", "emp", "empid", "staff"),
    ("account", "acct", "acctcode", "acctnum"),
    ("contact", "observer", "first", "last", "organization"),
)

# Operator hints as (bonus, words in the question, parts of the column name).
DATE_HINT = (0.35, ("year", "month", "day", "date"), ("year", "month", "date", "time"))
COUNT_HINT = (0.25, ("count", "number", "num", "total"), ("count", "num", "total", "number"))
AVERAGE_HINT = (0.15, ("average", "avg", "mean"), ("avg", "mean", "rate", "percent"))

# Score weights.
COLUMN_OVERLAP_WEIGHT = 1.35
TABLE_OVERLAP_WEIGHT = 0.75
BEST_COLUMN_WEIGHT = 0.70
TOP_COLUMNS_WEIGHT = 0.15
TOP_COLUMNS = 4
PLAIN_NAME_BONUS = 3.0
COMPACT_NAME_BONUS = 1.5
COMPACT_NAME_MIN_LENGTH = 4
KEY_BONUS = 0.05

# Prompt texts.
SYSTEM_PROMPT_IDS = (
    "You are a schema linking assistant. Given a database schema candidate list "
    "and a natural language question, output ONLY a JSON object. The JSON keys "
    "must be table IDs like T1 and the values must be lists of column IDs like "
    "C1. Use an empty list [] for a referenced table with no specific columns. "
    "Do not explain. Do not output table or column names."
)
SYSTEM_PROMPT_NAMES = (
    "You are a schema linking assistant. Given a database schema candidate list "
    "and a natural language question, output ONLY a JSON object mapping each "
    "referenced table name to a list of referenced column names. Use an empty "
    "list [] for a referenced table with no specific columns. Use only provided "
    "schema identifiers. Do not explain."
)
CANDIDATE_HEADER_IDS = "Candidate schema. Use the IDs, not names, in your JSON answer."
CANDIDATE_HEADER_NAMES = (
    "Candidate schema. Use the exact table and column names in your JSON answer."
)
INSTRUCTION_IDS = (
    'Return ONLY JSON of table IDs to column-ID lists. Example: {"T1":["C2"],"T3":[]} . '
    "Include a table ID with [] when the table is referenced but no specific column is used, such as COUNT(*). "
    "Do not include columns merely because they appear in the candidate schema."
)
INSTRUCTION_NAMES = (
    "Return ONLY JSON of table names to column-name lists. Include a table with [] when the table is referenced "
    "but no specific column is used, such as COUNT(*). Do not copy whole tables."
)
SFT_SYSTEM_PROMPT = "You output only valid JSON schema links."
FULL_PROMPT_HEAD = (
    "You are given a database schema and a natural language question.\n"
    "Return ONLY valid JSON mapping table names to lists of column names.\n"
    "Include tables even if no specific columns are used.\n"
    "Do not include explanations.\n\nSchema:\n"
)

# Databases and database families that get extra training copies.
TARGET_DATABASES = ("NTSB", "NYSED_SRC2022")
TARGET_PREFIXES = ("SBODemoUS",)

# SQL fragments the difficulty rules look for, blanks included.
GROUP_ORDER_FRAGMENTS = ("group by", "order by", "having")
AGGREGATE_FRAGMENTS = ("count(", "sum(", "avg(", "min(", "max(", "distinct")
SUBQUERY_FRAGMENTS = (" exists", " in (", " not in (", "select top", "select max", "select min")

# Fixed value: marker of an identifier that the schema does not have.
UNKNOWN_MARK = "__hallu__:"

# Fixed value: label of a position that carries no loss.
IGNORED_LABEL = -100


def synonyms() -> dict[str, list[str]]:
    """Each word with the sorted union of the groups that hold it."""
    words = sorted({word for group in SYNONYM_GROUPS for word in group})
    return {
        word: sorted({other for group in SYNONYM_GROUPS if word in group for other in group})
        for word in words
    }
