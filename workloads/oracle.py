"""The same results in DuckDB SQL over the given tables.

The SQL works on the template rows of the four families where the Spark side
works on whole schema documents, and on plain joins and windows where the
Spark side works on nested rows.
"""

from __future__ import annotations

from schemaloom import vocabulary as V
from workloads import templates as X
from workloads.queries import BUDGET, INPUT_LENGTH, MAX_LENGTH, SEED, TARGETS


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(lit(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def _template_columns():
    for f, family in enumerate(X.FAMILIES):
        doc = X.document(family)
        types, pairs = doc["column_types"], doc["column_names_original"]
        shift = 1 if len(types) == len(pairs) - 1 else 0
        ends = {end for pair in doc["foreign_keys"] for end in pair}
        sources = {pair[0] for pair in doc["foreign_keys"]}
        for i, (t, name) in enumerate(pairs):
            if t >= 0:
                kind = types[i - shift] if i - shift < len(types) else "unknown"
                plain = types[i] if i < len(types) else None
                yield (
                    f, t, doc["table_names_original"][t], i, name, kind, plain,
                    i in doc["primary_keys"], i in ends, i in sources,
                )


def _template_tables():
    for f, family in enumerate(X.FAMILIES):
        for t, (name, _) in enumerate(X.TABLES[family]):
            yield f, t, name


def _template_edges():
    for f, family in enumerate(X.FAMILIES):
        names = [name for name, _ in X.TABLES[family]]
        both = {
            pair
            for (a, _), (b, _) in X.FOREIGN_KEYS[family]
            for pair in ((a, b), (b, a))
            if a != b
        }
        for a, b in sorted(both):
            yield f, names.index(a), names.index(b), a, b


KEY = "replace(replace(db_id, ' ', '_'), '/', '_')"


def filled(column: str) -> str:
    text = column
    for mark, value in (
        ("{year}", "CAST(year(o_orderdate) AS VARCHAR)"),
        ("{seg}", "c_mktsegment"),
        ("{prio}", "o_orderpriority"),
        ("{key}", "CAST(o_orderkey AS VARCHAR)"),
    ):
        text = f"replace({text}, '{mark}', {value})"
    return text


BASE = f"""
fam(f, fname, n_tpl) AS ({values([(i, name, len(X.TEMPLATES[name])) for i, name in enumerate(X.FAMILIES)])}),
tcol(f, table_idx, table_name, col_idx, col_name, col_type, plain_type, is_pk, is_fk, is_src) AS ({values(_template_columns())}),
ttab(f, table_idx, table_name) AS ({values(_template_tables())}),
tedge(f, src, dst, src_table, dst_table) AS ({values(_template_edges())}),
tpl(f, n, q, links, sql) AS ({values(X.rows())}),
cust0 AS (SELECT customer.*, fam.f, fam.n_tpl, fname || ' ' || c_name AS db_id FROM customer JOIN fam ON fam.f = c_custkey % 4),
cust AS (SELECT *, {KEY} AS db_key FROM cust0),
docs AS (SELECT f, db_id, db_key FROM cust),
ex AS (SELECT o_orderkey AS question_id, cust.f, tpl.n AS tn, db_id, db_key, {filled('q')} AS question,
  {filled('sql')} AS gold_sql, links AS links_json, o_orderstatus, o_orderpriority, o_totalprice
  FROM orders JOIN cust ON o_custkey = c_custkey JOIN tpl ON tpl.f = cust.f AND tpl.n = o_orderkey % cust.n_tpl),
exd AS (SELECT ex.* FROM ex WHERE db_key IN (SELECT db_key FROM docs))
"""

STOP = lit(list(V.STOPWORDS))
SYN = "map(" + lit(list(V.synonyms())) + ", " + lit(list(V.synonyms().values())) + ")"
WORD = "[a-z0-9]+"


def words(x: str) -> str:
    found = f"regexp_extract_all(lower(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '{WORD}')"
    kept = f"list_filter({found}, lambda w: NOT list_contains({STOP}, w))"
    return (
        f"flatten(list_transform({kept}, lambda w: "
        f"CASE WHEN w LIKE '%s' AND length(w) > 3 THEN [w, left(w, length(w) - 1)] ELSE [w] END))"
    )


def expanded(x: str) -> str:
    return (
        f"list_filter(flatten(list_transform({words(x)}, lambda w: list_concat([w], coalesce({SYN}[w], [])))), "
        f"lambda w: NOT list_contains({STOP}, w))"
    )


def any_contains(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"


def hint(q: str, c: str, h) -> str:
    return f"(CASE WHEN list_has_any({q}, {lit(list(h[1]))}) AND {any_contains(c, h[2])} THEN {h[0]}::DOUBLE ELSE 0.0::DOUBLE END)"


def substring(q_lc: str, q_compact: str, name: str) -> str:
    plain = f"trim(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'))"
    short = f"regexp_replace(lower({name}), '[^a-z0-9]+', '', 'g')"
    return (
        f"((CASE WHEN {plain} <> '' AND contains({q_lc}, {plain}) THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) + "
        f"(CASE WHEN length({short}) >= 4 AND contains({q_compact}, {short}) THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END))"
    )


def overlap(q: str, n: str) -> str:
    return (
        f"(CASE WHEN len(list_intersect({q}, {n})) > 0 "
        f"THEN len(list_intersect({q}, {n}))::DOUBLE / sqrt(len(list_distinct({n}))::DOUBLE) ELSE 0.0::DOUBLE END)"
    )


PARTS = f"""
qf AS (SELECT question_id, f, lower(question) AS lc, regexp_replace(lower(question), '[^a-z0-9]+', '', 'g') AS compact,
  list_distinct({expanded('question')}) AS words FROM exd),
cf AS (SELECT *, {words('col_name')} AS words FROM tcol),
tf AS (SELECT *, {words('table_name')} AS words FROM ttab),
cpart AS (SELECT question_id, qf.f, table_idx, table_name, col_idx, col_name, col_type, is_pk, is_fk,
  {overlap('qf.words', 'cf.words')} AS overlap, {substring('lc', 'compact', 'col_name')} AS substring,
  {hint('qf.words', 'lower(col_name)', V.DATE_HINT)} AS h1, {hint('qf.words', 'lower(col_name)', V.COUNT_HINT)} AS h2,
  {hint('qf.words', 'lower(col_name)', V.AVERAGE_HINT)} AS h3,
  (CASE WHEN is_pk OR is_fk THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) AS key_bonus
  FROM qf JOIN cf ON qf.f = cf.f)
"""

SCORES = f"""{PARTS},
cs AS (SELECT *, 1.35::DOUBLE * overlap + substring + h1 + h2 + h3 + key_bonus AS score FROM cpart),
ctop AS (SELECT question_id, table_idx, list(score ORDER BY score DESC) AS s FROM cs GROUP BY ALL),
ts AS (SELECT qf.question_id, qf.f, tf.table_idx, table_name,
  0.75::DOUBLE * {overlap('qf.words', 'tf.words')} + {substring('lc', 'compact', 'table_name')}
  + 0.70::DOUBLE * s[1] + 0.15::DOUBLE * (0.0::DOUBLE + s[1] + coalesce(s[2], 0.0::DOUBLE) + coalesce(s[3], 0.0::DOUBLE) + coalesce(s[4], 0.0::DOUBLE)) AS score
  FROM qf JOIN tf ON qf.f = tf.f JOIN ctop ON ctop.question_id = qf.question_id AND ctop.table_idx = tf.table_idx),
tr AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, lower(table_name) DESC, table_idx) AS rk FROM ts),
ordered AS (SELECT question_id, f, list(table_idx ORDER BY rk) AS ord FROM tr GROUP BY question_id, f),
adj AS (SELECT f, list(near ORDER BY table_idx) AS adj FROM (SELECT ttab.f, ttab.table_idx,
  coalesce(list(dst) FILTER (dst IS NOT NULL), []) AS near FROM ttab LEFT JOIN tedge ON ttab.f = tedge.f AND src = table_idx GROUP BY ALL) GROUP BY f)
"""

REPEATED = f"""
rep AS (SELECT event_id AS question_id, f, 'Total o_totalprice and name for ' || event_type || ' events by month with value '
  || event_id % {X.REPEATED_VALUES} AS question FROM events JOIN cust ON c_custkey = user_id % {X.SHARED_DATABASES}),
texts AS (SELECT row_number() OVER () AS question_id, f, question FROM (SELECT DISTINCT f, question FROM rep))
"""

LINKS = """
el AS (SELECT tpl.f, tpl.n AS tn, unnest(json_keys(links)) AS t FROM tpl),
lt AS (SELECT el.f, el.tn, el.t AS table_name, from_json(json_extract(tpl.links, '$."' || el.t || '"'), '["VARCHAR"]') AS cols
  FROM el JOIN tpl ON tpl.f = el.f AND tpl.n = el.tn)
"""


def neighbours(chosen: str, seeds: int, limit: int) -> str:
    return (
        f"list_reduce(list_transform(list_slice({chosen}, 1, {seeds}), lambda s: [s]), lambda acc, s: "
        f"list_concat(acc, list_slice(list_filter(ord, lambda m: list_contains(adj[s[1] + 1], m) "
        f"AND NOT list_contains(acc, m)), 1, {limit})), {chosen})"
    )


def candidates(forced: bool) -> str:
    """CTEs ending in `cand`: one row per candidate column with its ranks."""
    if forced:
        base = (
            f"forced AS (SELECT exd.question_id, list(ttab.table_idx ORDER BY ttab.table_idx) AS forced FROM exd "
            f"JOIN lt ON lt.f = exd.f AND lt.tn = exd.tn JOIN ttab ON ttab.f = exd.f AND ttab.table_name = lt.table_name "
            f"GROUP BY exd.question_id), "
            f"first_choice AS (SELECT question_id, ordered.f, ord, adj, list_concat(list_slice(ord, 1, {BUDGET.max_tables}), "
            f"list_filter(forced, lambda x: NOT list_contains(list_slice(ord, 1, {BUDGET.max_tables}), x))) AS base "
            f"FROM ordered JOIN adj USING (f) JOIN forced USING (question_id))"
        )
        is_forced = "coalesce(list_contains(lt.cols, cs.col_name), FALSE)"
        join = (
            "JOIN exd USING (question_id) LEFT JOIN lt ON lt.f = exd.f AND lt.tn = exd.tn "
            "AND lt.table_name = cs.table_name"
        )
    else:
        base = (
            f"first_choice AS (SELECT question_id, ordered.f, ord, adj, list_slice(ord, 1, {BUDGET.max_tables}) AS base "
            f"FROM ordered JOIN adj USING (f))"
        )
        is_forced, join = "FALSE", ""
    return f"""{base},
chosen AS (SELECT question_id, f, {neighbours('base', BUDGET.max_tables, BUDGET.join_neighbor_limit)} AS ch FROM first_choice),
ct AS (SELECT question_id, unnest(ch) AS table_idx, unnest(range(1, len(ch) + 1)) AS t_rank FROM chosen),
kept AS (SELECT cs.*, ct.t_rank, {is_forced} AS forced, row_number() OVER (PARTITION BY question_id, cs.table_idx
  ORDER BY {is_forced} DESC, cs.score DESC, (is_pk OR is_fk) DESC, lower(col_name) DESC, col_idx) AS place
  FROM cs JOIN ct USING (question_id, table_idx) {join}),
cand AS (SELECT *, row_number() OVER (PARTITION BY question_id, table_idx ORDER BY col_idx) AS c_rank
  FROM kept WHERE place <= {BUDGET.columns_kept} OR forced)
"""


def with_(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


SUFFIX = "' [' || concat_ws(' ', col_type, CASE WHEN is_pk THEN 'PK' END, CASE WHEN is_fk THEN 'FK' END) || ']'"


def user_text(output_format: str) -> str:
    """CTEs ending in `usr`: the user message of each question over `cand`."""
    ids = output_format == "ids"
    head = "'T' || t_rank || ' = ' || table_name" if ids else "'Table: ' || table_name"
    line = "'  C' || c_rank || ' = '" if ids else "'  - '"
    instruction = V.INSTRUCTION_IDS if ids else V.INSTRUCTION_NAMES
    header = V.CANDIDATE_HEADER_IDS if ids else V.CANDIDATE_HEADER_NAMES
    return f"""
tl AS (SELECT question_id, t_rank, {head} || chr(10) || string_agg({line} || col_name || {SUFFIX}, chr(10) ORDER BY c_rank) AS block
  FROM cand GROUP BY question_id, t_rank, table_name),
usr AS (SELECT question_id, db_id, question, {lit(instruction)} || chr(10) || chr(10) || {lit(header)} || chr(10)
  || string_agg(block, chr(10) ORDER BY t_rank) || chr(10) || chr(10) || 'Question:' || chr(10) || question
  || chr(10) || chr(10) || 'JSON answer:' AS user_text FROM tl JOIN exd USING (question_id) GROUP BY question_id, db_id, question)
"""


TARGETS_CTE = """
tgt0 AS (SELECT exd.question_id, ttab.table_idx, lt.table_name, lt.cols FROM exd JOIN lt ON lt.f = exd.f AND lt.tn = exd.tn
  JOIN ttab ON ttab.f = exd.f AND ttab.table_name = lt.table_name),
tgt1 AS (SELECT tgt0.question_id, tgt0.table_idx, tgt0.table_name, any_value(cand.t_rank) AS t_rank,
  coalesce(string_agg('"C' || c_rank || '"', ',' ORDER BY col_idx) FILTER (list_contains(cols, col_name)), '') AS id_cols
  FROM tgt0 JOIN cand USING (question_id, table_idx) GROUP BY tgt0.question_id, tgt0.table_idx, tgt0.table_name),
tgt2 AS (SELECT tgt1.*, coalesce((SELECT string_agg('"' || col_name || '"', ',' ORDER BY col_idx) FROM tcol, lt, exd
  WHERE exd.question_id = tgt1.question_id AND lt.f = exd.f AND lt.tn = exd.tn AND lt.table_name = tgt1.table_name
  AND tcol.f = exd.f AND tcol.table_name = lt.table_name AND list_contains(lt.cols, tcol.col_name)), '') AS name_cols FROM tgt1),
tgt AS (SELECT exd.question_id,
  '{' || coalesce(string_agg('"T' || t_rank || '":[' || id_cols || ']', ',' ORDER BY table_idx) FILTER (t_rank IS NOT NULL), '') || '}' AS ids,
  '{' || coalesce(string_agg('"' || table_name || '":[' || name_cols || ']', ',' ORDER BY table_idx) FILTER (t_rank IS NOT NULL), '') || '}' AS names
  FROM exd LEFT JOIN tgt2 USING (question_id) GROUP BY exd.question_id)
"""

ODD = lit(X.ODD_ANSWER)
GHOST = lit('{"ghost_table":["ghost_col"]}')
RUNS = f"""
runs(run_id) AS ({values([(r,) for r in X.RUNS])}),
asked AS (SELECT ex.*, run_id, (question_id // 12 + run_id) % 8 AS v FROM ex, runs
  WHERE NOT (o_orderstatus = 'P' AND CAST(left(o_orderpriority, 1) AS INT) = run_id) AND NOT (run_id = 4 AND o_orderstatus = 'F'))
"""
# Every question answered by every run.
ALL_RUNS = RUNS[: RUNS.index("  WHERE NOT")].rstrip() + ")"
PREDICTIONS = f"""{RUNS},
ptext AS (SELECT *, CASE v WHEN 2 THEN NULL WHEN 1 THEN upper(links_json) WHEN 4 THEN {GHOST}
  WHEN 5 THEN replace(links_json, ']', ',"no_such_col"]') WHEN 6 THEN '{{}}' WHEN 7 THEN {ODD} ELSE links_json END AS links FROM asked),
preds AS (SELECT run_id, question_id, links AS links_json, 0 AS pos FROM ptext
  UNION ALL SELECT run_id, question_id, '{{}}', 1 FROM ptext WHERE o_totalprice < 10000
  UNION ALL SELECT run_id, -1 - question_id, links, 2 FROM ptext WHERE o_totalprice > 490000)
"""

ALL_PREDICTIONS = PREDICTIONS.replace(RUNS, ALL_RUNS).replace("WHEN 2 THEN NULL ", "")

# Links text -> (table, items) rows as the scorer reads them. `src` has an `id`.
def scorer_rows(src: str, name: str, marked: bool) -> str:
    """CTEs ending in `{name}t`, `{name}p`: members of the sets, by row id."""
    return f"""
{name}k AS (SELECT id, f, links, unnest(json_keys(links)) AS k FROM (SELECT id, f, links FROM {src} WHERE json_valid(links))),
{name}v AS (SELECT id, f, k, json_type(links, '$."' || k || '"') = 'ARRAY' AS is_list,
  CASE WHEN json_type(links, '$."' || k || '"') = 'ARRAY' THEN from_json(json_extract(links, '$."' || k || '"'), '["JSON"]') ELSE CAST([] AS JSON[]) END AS items FROM {name}k),
{name}r AS (SELECT {name}v.*, ttab.table_name AS real, coalesce(ttab.table_name, '__hallu__:' || lower(k)) AS label
  FROM {name}v LEFT JOIN ttab ON ttab.f = {name}v.f AND lower(ttab.table_name) = lower(k)),
{name}i AS (SELECT id, f, real, label, lower(coalesce(json_extract_string(unnest(items), '$'), 'none')) AS c FROM {name}r),
{name}c AS (SELECT {name}i.*, tcol.col_name AS real_col FROM {name}i LEFT JOIN tcol ON tcol.f = {name}i.f AND tcol.table_name = {name}i.real
  AND lower(tcol.col_name) = c),
{name}t AS (SELECT DISTINCT id, label AS m FROM {name}r {'' if marked else 'WHERE real IS NOT NULL'}),
{name}p AS (SELECT DISTINCT id, label || '.' || coalesce(real_col, '__hallu__:' || c) AS m FROM {name}c {'' if marked else 'WHERE real_col IS NOT NULL'}),
{name}b AS (SELECT src.id, coalesce(bt, 0) AS bad_tables, coalesce(bc, 0) AS bad_columns FROM {src} src
  LEFT JOIN (SELECT id, count(*) AS bt FROM {name}r WHERE real IS NULL GROUP BY id) x ON x.id = src.id
  LEFT JOIN (SELECT id, count(*) AS bc FROM {name}c WHERE real_col IS NULL GROUP BY id) y ON y.id = src.id)
"""


LASTS = """lasts AS (SELECT run_id, question_id, arg_max({'l': links_json}, pos).l AS links_json, count(*) AS entries FROM preds GROUP BY ALL)"""
GOLD = """gold AS (SELECT question_id, links_json FROM ex WHERE o_totalprice <= 495000
  UNION ALL SELECT -1 - question_id, links_json FROM ex WHERE o_totalprice > 492000)"""


def level(name: str) -> str:
    return f"""
n{name} AS (SELECT s.id, (SELECT NULL) AS z, count(*) FILTER (inp AND ing) AS tp, count(*) FILTER (inp) AS np, count(*) FILTER (ing) AS ng
  FROM sc s LEFT JOIN (SELECT id, m, bool_or(p) AS inp, bool_or(g) AS ing FROM (
    SELECT id, m, TRUE AS p, FALSE AS g FROM p{name} UNION ALL SELECT sc.id, m, FALSE, TRUE FROM g{name} JOIN sc ON sc.question_id = g{name}.id)
    GROUP BY id, m) u ON u.id = s.id GROUP BY s.id),
x{name} AS (SELECT id, CASE WHEN np > 0 THEN tp / np WHEN ng = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p,
  CASE WHEN ng > 0 THEN tp / ng ELSE 1.0::DOUBLE END AS r FROM n{name}),
f{name} AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM x{name})
"""


SCORED = f"""{PREDICTIONS},
{LASTS},
{GOLD},
gsrc AS (SELECT question_id AS id, f, gold.links_json AS links FROM gold JOIN exd USING (question_id)),
sc AS (SELECT question_id * 10 + runs.run_id AS id, runs.run_id, question_id, exd.db_id, exd.f, lasts.links_json AS links, lasts.entries
  FROM exd JOIN gold USING (question_id) CROSS JOIN runs LEFT JOIN lasts USING (run_id, question_id)),
{scorer_rows('gsrc', 'g', False).strip()},
{scorer_rows('sc', 'p', True).strip()},
{level('t').strip()},
{level('p').strip()},
rws AS (SELECT run_id, question_id, db_id, ft.p AS p_t, ft.r AS r_t, ft.f1 AS f1_t, fp.p AS p_c, fp.r AS r_c, fp.f1 AS f1_c,
  bad_tables, bad_columns, entries IS NULL AS is_missing FROM sc JOIN ft USING (id) JOIN fp USING (id) JOIN pb USING (id))
"""
METRICS = ("p_t", "r_t", "f1_t", "p_c", "r_c", "f1_c")


def averages(*keys: str) -> str:
    k = ", ".join(keys)
    avg = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
    return f"""
av AS (SELECT {k}, {avg}, count(*) AS questions, count(*) FILTER (is_missing) AS missing,
  sum(bad_tables)::BIGINT AS bad_tables, sum(bad_columns)::BIGINT AS bad_columns FROM rws GROUP BY {k}),
sc1 AS (SELECT *, (p_t + r_t + f1_t) / 3.0 AS table_score, (p_c + r_c + f1_c) / 3.0 AS column_score FROM av),
macro AS (SELECT *, 0.5 * table_score + 0.5 * column_score AS leaderboard_score FROM sc1)
"""


ROUNDED = ", ".join(
    f"round({m}, 6) AS {m}" for m in (*METRICS, "table_score", "column_score", "leaderboard_score")
)
REPORTED = {
    "leaderboard_score": "leaderboard_score", "precision_t": "p_t", "recall_t": "r_t", "f1_t": "f1_t",
    "table_score": "table_score", "precision_c": "p_c", "recall_c": "r_c", "f1_c": "f1_c",
    "column_score": "column_score",
}
PRINTED = ", ".join(f"CAST(format('{{:.4f}}', {c}) AS DOUBLE) AS {name}" for name, c in REPORTED.items())
BOARD = f"""
named AS (SELECT run_id, 'sweep_run' || run_id AS run_name, 'sweep/runs/' || run_id || '/checkpoints/final_checkpoint' AS adapter_dir,
  'base-1.5b' AS base_model FROM (SELECT run_id FROM runs UNION ALL SELECT {X.FAILED_RUN})),
printed AS (SELECT run_id, {PRINTED} FROM macro),
board AS (SELECT named.*, {', '.join(f'coalesce({m}, -1.0::DOUBLE) AS {m}' for m in REPORTED)},
  CASE WHEN leaderboard_score IS NULL THEN 'infer_failed' ELSE 'ok' END AS status FROM named LEFT JOIN printed USING (run_id))
"""

SHAPES = f"""{LINKS},
shape AS (SELECT ex.*, nt AS num_tables, nc AS num_columns, has_empty FROM ex JOIN (SELECT f, tn, count(*)::INT AS nt, sum(len(cols))::INT AS nc,
  bool_or(len(cols) = 0) AS has_empty FROM lt GROUP BY f, tn) s USING (f, tn)),
dbn AS (SELECT db_id, count(*) AS n FROM ex GROUP BY db_id)
"""

BALANCED = f"""{SHAPES},
firsts AS (SELECT shape.*, n, row_number() OVER (PARTITION BY db_id ORDER BY o_totalprice, question_id) AS rn FROM shape JOIN dbn USING (db_id)),
balanced AS (SELECT question_id, db_id, num_tables, num_columns, has_empty, 'original' AS source, FALSE AS is_oversampled FROM shape
  UNION ALL SELECT question_id, db_id, num_tables, num_columns, has_empty, 'oversampled', TRUE FROM firsts
  WHERE n < 10 AND rn <= least(2 * n, 10) - n)
"""


def stats(stage: str, src: str) -> str:
    return f"""SELECT '{stage}' AS stage, count(*) AS total_examples, count(DISTINCT db_id) AS unique_databases,
count(*) FILTER (num_tables > 1) AS multi_table_examples, count(*) FILTER (num_tables <= 1) AS single_table_examples,
count(*) FILTER (has_empty) AS empty_column_examples, count(*) FILTER (num_columns >= 3) AS many_column_examples,
count(*) FILTER (is_oversampled) AS oversampled_examples, count(*) FILTER (NOT is_oversampled) AS original_examples,
round(avg(num_tables), 6) AS avg_tables_per_example, round(avg(num_columns), 6) AS avg_columns_per_example,
max(num_tables) AS max_tables, max(num_columns) AS max_columns FROM {src}"""


def sql_any(parts) -> str:
    return any_contains("lower(gold_sql)", parts)


JOINS = "len(regexp_extract_all(lower(gold_sql), '\\bjoin\\b'))"
WORDS = "len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> ''))"


def rule(*cases) -> str:
    points = " ".join(f"WHEN {c} THEN {p}" for c, p, _ in cases)
    reasons = " ".join(f"WHEN {c} THEN {r}" for c, _, r in cases)
    return f"CASE {points} ELSE 0 END", f"CASE {reasons} END"


RULES = [
    rule(("n < 10", 5, "'underrepresented_db:' || n"), ("n <= 12", 2, "'low_resource_db:' || n")),
    rule(("num_tables >= 3", 5, "'many_tables:' || num_tables"), ("num_tables = 2", 3, "'two_tables'")),
    rule(("num_columns >= 8", 4, "'many_columns:' || num_columns"), ("num_columns >= 5", 2, "'medium_columns:' || num_columns")),
    rule(("has_empty", 4, "'empty_column_table'")),
    rule((f"{JOINS} >= 2", 3, f"'multi_join:' || {JOINS}"), (f"{JOINS} = 1", 2, "'join'")),
    rule((sql_any(V.GROUP_ORDER_FRAGMENTS), 2, "'group_order_having'")),
    rule((sql_any(V.AGGREGATE_FRAGMENTS), 1, "'aggregate_or_distinct'")),
    rule((sql_any(V.SUBQUERY_FRAGMENTS), 3, "'subquery_or_top'")),
    rule((f"{WORDS} >= 25", 1, "'long_question'")),
]
DIFFICULTY = f"""{SHAPES},
diff AS (SELECT question_id, db_id, n, {' + '.join('(' + p + ')' for p, _ in RULES)} AS score,
  concat_ws(';', {', '.join(r for _, r in RULES)}) AS reasons, num_tables, num_columns, o_totalprice FROM shape JOIN dbn USING (db_id)),
sel AS (SELECT * EXCLUDE (o_totalprice) FROM diff WHERE score >= 9
  ORDER BY score DESC, num_tables DESC, num_columns DESC, n, o_totalprice, question_id LIMIT 90)
"""


def hashed(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 15) AS BIGINT)"


def token_ids(x: str) -> str:
    found = f"regexp_extract_all({x}, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')"
    return f"list_transform({found}, lambda t: (CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 50000)::INT)"


PAIRS = f"""
pr0 AS (SELECT question_id, {token_ids('question')} AS p, {token_ids('links_json')} AS a FROM ex),
pr1 AS (SELECT question_id, p, CASE WHEN len(a) >= {MAX_LENGTH} THEN list_concat(a[1:{MAX_LENGTH - 1}], [0]) ELSE a END AS a FROM pr0),
pr AS (SELECT question_id, len(p) > {MAX_LENGTH} - len(a) AS truncated, CASE WHEN {MAX_LENGTH} - len(a) <= 0 THEN []
  ELSE p[greatest(1, len(p) - ({MAX_LENGTH} - len(a)) + 1):] END AS p, a FROM pr1),
mk AS (SELECT question_id, list_concat(p, a) AS i, list_transform(list_concat(p, a), lambda x: 1) AS m,
  list_concat(list_transform(p, lambda x: -100), a) AS l FROM pr)
"""


def text(arr: str) -> str:
    return f"array_to_string({arr}, ',')"


def padded(arr: str, value: int) -> str:
    return text(f"list_concat({arr}, list_transform(range(longest - len({arr})), lambda x: {value}))")


def build() -> dict[str, str]:
    free = candidates(False)
    forced = candidates(True)
    q: dict[str, str] = {}

    q["db_keys"] = with_("SELECT c_custkey, db_id, db_key FROM cust", BASE)
    q["catalog_columns"] = with_(
        "SELECT db_key, table_idx, table_name, col_idx, col_name, col_type, is_pk, is_fk FROM docs JOIN tcol USING (f)", BASE
    )
    q["catalog_columns_source_keys"] = with_(
        "SELECT db_key, col_idx, is_pk, is_src AS is_fk FROM docs JOIN tcol USING (f)", BASE
    )
    q["catalog_tables"] = with_("SELECT db_key, table_idx, table_name FROM docs JOIN ttab USING (f)", BASE)
    q["fk_edges"] = with_("SELECT db_key, src_table, dst_table FROM docs JOIN tedge USING (f)", BASE)
    q["schema_map"] = with_(
        "SELECT db_key, table_name, string_agg(col_name, ',' ORDER BY col_idx) AS cols FROM docs JOIN tcol USING (f) GROUP BY db_key, table_name",
        BASE,
    )
    q["schema_lookup"] = with_(
        "SELECT db_key, lower(table_name) AS table_lc, lower(col_name) AS col_lc, table_name, col_name FROM docs JOIN tcol USING (f)",
        BASE,
    )
    q["columns_by_table"] = with_(
        "SELECT db_key, table_idx, table_name, col_idx, col_name, plain_type AS col_type, is_pk, is_src AS is_fk "
        "FROM docs JOIN tcol USING (f) WHERE plain_type IS NOT NULL",
        BASE,
    )
    full_text = """
fl AS (SELECT f, table_name, 'Table: ' || table_name || chr(10) || '  Columns:' || chr(10) || string_agg('  - ' || col_name || ' [' || plain_type || ']'
  || CASE WHEN is_pk THEN ' PRIMARY KEY' ELSE '' END || CASE WHEN is_src THEN ' FOREIGN KEY' ELSE '' END, chr(10) ORDER BY col_name, col_idx) AS block
  FROM tcol WHERE plain_type IS NOT NULL GROUP BY f, table_name),
ft0 AS (SELECT f, 'Database schema:' || chr(10) || string_agg(block, chr(10) ORDER BY table_name) AS schema_text FROM fl GROUP BY f)
"""
    q["full_schema_text"] = with_("SELECT db_key, schema_text FROM docs JOIN ft0 USING (f)", BASE, full_text)

    q["identifier_tokens"] = with_(
        f"SELECT db_key, col_idx, tokens FROM docs JOIN (SELECT f, col_idx, {text(words('col_name'))} AS tokens FROM tcol) USING (f)", BASE
    )
    q["question_tokens"] = with_(
        f"SELECT question_id, {text('list_filter(w, lambda x, i: list_position(w, x) = i)')} AS tokens "
        f"FROM (SELECT question_id, {expanded('question')} AS w FROM ex)",
        BASE,
    )
    q["document_tokens"] = f"""WITH d AS (SELECT doc_id, {expanded('text')} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
o AS (SELECT doc_id, t, min(i) AS i FROM e GROUP BY doc_id, t),
s AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY i) AS j FROM o GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0)::INT AS n_tokens, md5(coalesce(j, '')) AS tokens_md5 FROM documents LEFT JOIN s USING (doc_id)"""
    count = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::INT AS n_words"
    q["text_word_counts"] = (
        f"SELECT 'documents' AS source, doc_id AS id, 0 AS turn, {count} FROM documents "
        f"UNION ALL SELECT 'conversations', conv_id, turn::INT, {count} FROM conversations"
    )
    q["lexical_evidence"] = with_(
        "SELECT question_id, col_idx, round(overlap, 6) AS overlap, substring, round(h1 + h2 + h3, 6) AS hints, key_bonus FROM cpart",
        BASE, PARTS,
    )
    q["sql_features"] = with_(
        f"SELECT question_id, {JOINS}::INT AS joins, {sql_any(V.GROUP_ORDER_FRAGMENTS)} AS groups_or_orders, "
        f"{sql_any(V.AGGREGATE_FRAGMENTS)} AS aggregates, {sql_any(V.SUBQUERY_FRAGMENTS)} AS has_subquery, "
        f"{WORDS}::INT AS question_words FROM ex",
        BASE,
    )

    q["column_scores"] = with_("SELECT question_id, col_idx, round(score, 6) AS score FROM cs", BASE, SCORES)
    q["table_scores"] = with_(
        "SELECT question_id, table_idx, table_name, round(score, 6) AS score FROM ts", BASE, SCORES
    )
    q["topk_tables"] = with_(
        "SELECT question_id, rk AS t_rank, table_name, round(score, 6) AS score FROM tr WHERE rk <= 3", BASE, SCORES
    )
    q["topk_tables_indexed"] = q["topk_tables"]
    q["topk_tables_bucketed"] = q["topk_tables"]
    q["topk_tables_repeated"] = with_(
        "SELECT rep.question_id, rk AS t_rank, table_name, round(score, 6) AS score FROM tr "
        "JOIN texts USING (question_id) JOIN rep ON rep.f = texts.f AND rep.question = texts.question WHERE rk <= 3",
        BASE, REPEATED, SCORES.replace("FROM exd)", "FROM texts)"),
    )
    q["forced_tables"] = with_(
        "SELECT exd.question_id, row_number() OVER (PARTITION BY exd.question_id ORDER BY table_idx) - 1 AS place, lt.table_name "
        "FROM exd JOIN lt ON lt.f = exd.f AND lt.tn = exd.tn JOIN tr ON tr.question_id = exd.question_id AND tr.table_name = lt.table_name "
        f"WHERE rk > {BUDGET.max_tables}",
        BASE, LINKS, SCORES,
    )
    q["join_neighbours"] = with_(
        f"SELECT question_id, array_to_string(list_transform(ch, lambda i: names[i + 1]), ',') AS chosen FROM ("
        f"SELECT question_id, f, {neighbours('list_slice(ord, 1, 2)', 2, 1)} AS ch FROM ordered JOIN adj USING (f)) "
        f"JOIN (SELECT f, list(table_name ORDER BY table_idx) AS names FROM ttab GROUP BY f) USING (f)",
        BASE, SCORES,
    )
    q["candidate_schema"] = with_(
        "SELECT question_id, t_rank, 'T' || t_rank AS table_id, table_name, c_rank, 'C' || c_rank AS column_id, col_name, col_type, is_pk, is_fk FROM cand",
        BASE, SCORES, free,
    )
    q["candidate_schema_indexed"] = q["candidate_schema"]
    q["forced_candidate_schema"] = with_(
        "SELECT question_id, t_rank, table_name, c_rank, col_name FROM cand", BASE, LINKS, SCORES, forced
    )
    wide = free
    for name in ("first_choice", "chosen", "ct", "kept", "cand"):
        wide = wide.replace(f"{name} AS (", f"w_{name} AS (")
    for name in ("first_choice", "chosen", "ct", "kept"):
        wide = wide.replace(f"FROM {name}", f"FROM w_{name}").replace(f"JOIN {name} ", f"JOIN w_{name} ")
    wide = wide.replace("ct.t_rank", "w_ct.t_rank").replace(
        f"list_slice(ord, 1, {BUDGET.max_tables}) AS base", "list_slice(ord, 1, 12) AS base"
    ).replace("list_slice(base, 1, 2)", "list_slice(base, 1, 12)").replace("1, 1)), base)", "1, 2)), base)").replace(
        f"place <= {BUDGET.columns_kept}", "place <= 20"
    )

    def recall(budget: str, cand: str) -> str:
        return f"""SELECT '{budget}' AS budget, question_id, any_value(db_id) AS db_id, count(*)::INT AS gold_tables,
count(*) FILTER (got)::INT AS found_tables, sum(want)::INT AS gold_columns, sum(have)::INT AS found_columns,
round(count(*) FILTER (got) / count(*), 6) AS table_recall,
round(CASE WHEN sum(want) > 0 THEN sum(have) / sum(want) END, 6) AS column_recall
FROM (SELECT exd.question_id, exd.db_id, lt.table_name, len(any_value(lt.cols)) AS want, count(c.col_name) > 0 AS got,
  count(*) FILTER (list_contains(lt.cols, c.col_name)) AS have
  FROM exd JOIN lt ON lt.f = exd.f AND lt.tn = exd.tn LEFT JOIN {cand} c ON c.question_id = exd.question_id AND c.table_name = lt.table_name
  GROUP BY exd.question_id, exd.db_id, lt.table_name) GROUP BY question_id"""

    q["retrieval_recall"] = with_(
        recall("small", "cand") + " UNION ALL " + recall("grid", "w_cand"), BASE, LINKS, SCORES, free, wide
    )

    def prompt(output_format: str) -> str:
        system = V.SYSTEM_PROMPT_IDS if output_format == "ids" else V.SYSTEM_PROMPT_NAMES
        return (
            f"SELECT question_id, 'System: ' || {lit(system)} || chr(10) || chr(10) || 'User: ' || user_text "
            f"|| chr(10) || chr(10) || 'Assistant:' AS prompt FROM usr"
        )

    q["parsed_settings"] = (
        "SELECT '/sweeps/' || c_custkey AS adapter_dir, CASE c_custkey % 4 WHEN 0 THEN 'names' ELSE 'ids' END AS output_format, "
        "2048 AS max_input_length, '{\"r\":' || c_custkey || '}' AS train_config, CAST(c_custkey % 30 AS INT) AS max_tables, "
        "18 AS max_columns_per_table, 4 AS min_columns_per_table, TRUE AS include_types, TRUE AS include_keys, "
        "TRUE AS include_join_neighbors, 2 AS join_neighbor_limit, TRUE AS always_include_table_columns_for_gold FROM customer"
    )
    q["prompt_ids"] = with_(prompt("ids"), BASE, SCORES, free, user_text("ids"))
    q["prompt_names"] = with_(prompt("names"), BASE, SCORES, free, user_text("names"))
    # Runs 1 and 2 have equal tables and columns; 3 and 4 have the wide budget.
    wide_text = user_text("ids").replace("FROM cand", "FROM w_cand")
    for name in ("tl", "usr"):
        wide_text = wide_text.replace(f"{name} AS (", f"w_{name} AS (")
    wide_text = wide_text.replace("FROM tl ", "FROM w_tl ")
    names_text = user_text("names").replace("tl AS (", "n_tl AS (").replace("usr AS (", "n_usr AS (").replace("FROM tl ", "FROM n_tl ")
    asked_by = lambda run, fmt, src: (
        f"SELECT {run} AS run_id, question_id, md5(prompt) AS prompt_md5 FROM ({prompt(fmt).replace('FROM usr', 'FROM ' + src)})"
    )
    q["prompts_by_run"] = with_(
        " UNION ALL ".join(
            asked_by(*x) for x in ((1, "ids", "usr"), (2, "names", "n_usr"), (3, "ids", "w_usr"), (4, "ids", "w_usr"))
        ),
        BASE, SCORES, free, wide, user_text("ids"), names_text, wide_text,
    )
    payload = (BASE, LINKS, SCORES, forced, user_text("ids"), TARGETS_CTE)
    q["example_payloads"] = with_(
        f"SELECT question_id, db_id, question, {lit(V.SYSTEM_PROMPT_IDS)} AS system, user_text AS user, ids AS assistant, "
        "'ids' AS output_format FROM usr JOIN tgt USING (question_id)",
        *payload,
    )
    q["chat_rows"] = with_(
        f"SELECT question_id, db_id, 0 AS turn, 'system' AS role, {lit(V.SYSTEM_PROMPT_IDS)} AS content FROM usr "
        "UNION ALL SELECT question_id, db_id, 1, 'user', user_text FROM usr "
        "UNION ALL SELECT question_id, db_id, 2, 'assistant', ids FROM usr JOIN tgt USING (question_id)",
        *payload,
    )
    q["target_json"] = with_(
        "SELECT question_id, 'ids' AS output_format, ids AS assistant FROM tgt UNION ALL SELECT question_id, 'names', names FROM tgt",
        BASE, LINKS, SCORES, free, TARGETS_CTE,
    )
    norm = """
nj0 AS (SELECT f, tn, '{' || string_agg('"' || table_name || '": [' || array_to_string(list_transform(list_sort(cols), lambda c: '"' || c || '"'), ', ') || ']',
  ', ' ORDER BY table_name) || '}' AS answer FROM lt GROUP BY f, tn)
"""
    q["normalized_json"] = with_("SELECT question_id, answer FROM ex JOIN nj0 USING (f, tn)", BASE, LINKS, norm)
    q["sft_records"] = with_(
        f"SELECT question_id, db_id, {lit(V.SFT_SYSTEM_PROMPT)} AS system, {lit(V.FULL_PROMPT_HEAD)} || schema_text || chr(10) || chr(10) "
        "|| 'Question:' || chr(10) || question || chr(10) || chr(10) || 'Answer:' AS user, answer AS assistant, 'original' AS source, "
        "num_tables, num_columns, num_tables > 1 AS is_multitable, has_empty AS has_empty_columns, FALSE AS is_oversampled "
        "FROM shape JOIN ft0 USING (f) JOIN nj0 USING (f, tn) WHERE db_key IN (SELECT db_key FROM docs)",
        BASE, SHAPES, full_text, norm,
    )

    # What each kind of answer holds, taken from the template and not from its text.
    odd = [
        ("orders", "o_orderkey"), ("customer", "c_name"), ("part", ""), ("lineitem", "l_tax"),
        ("events", "ts,ts"), ("EVENTS", "Value"), ("documents", ""),
    ]
    q["first_json"] = with_(
        "SELECT run_id, question_id, table_name AS key, array_to_string(cols, ',') AS names FROM asked JOIN lt USING (f, tn) WHERE v IN (0, 2, 3) "
        "UNION ALL SELECT run_id, question_id, upper(table_name), upper(array_to_string(cols, ',')) FROM asked JOIN lt USING (f, tn) WHERE v = 1 "
        "UNION ALL SELECT run_id, question_id, 'ghost_table', 'ghost_col' FROM asked WHERE v = 4 "
        "UNION ALL SELECT run_id, question_id, table_name, array_to_string(list_concat(cols, ['no_such_col']), ',') FROM asked JOIN lt USING (f, tn) "
        "WHERE v = 5 AND links_json NOT LIKE '%[]%' "
        f"UNION ALL SELECT run_id, question_id, k, n FROM asked, ({values(odd)}) AS o(k, n) WHERE v = 7",
        BASE, LINKS, ALL_RUNS,
    )
    q["event_props"] = (
        "SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value "
        "FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"
    )
    real = """
rl AS (SELECT lt.f, lt.tn, '{' || string_agg('"' || lt.table_name || '":[' || coalesce(cl, '') || ']', ',' ORDER BY ttab.table_idx) || '}' AS links
  FROM lt JOIN ttab ON ttab.f = lt.f AND ttab.table_name = lt.table_name
  LEFT JOIN (SELECT l2.f, l2.tn, l2.table_name, string_agg('"' || col_name || '"', ',' ORDER BY col_idx) AS cl FROM lt l2 JOIN tcol
    ON tcol.f = l2.f AND tcol.table_name = l2.table_name AND list_contains(l2.cols, col_name) GROUP BY ALL) x
  ON x.f = lt.f AND x.tn = lt.tn AND x.table_name = lt.table_name GROUP BY lt.f, lt.tn)
"""
    # The odd answer resolved against each family; parsing merges `events` and
    # `EVENTS`, normalising keeps the last of them.
    odd_retail = '{"customer":["c_name"],"part":[],"orders":["o_orderkey"],"lineitem":["l_tax"]}'
    parsed_odd = [(0, odd_retail), (1, '{"documents":[]}'), (2, '{"events":["ts","value"]}'), (3, "{}")]
    normal_odd = [(0, odd_retail), (1, '{"documents":[]}'), (2, '{"events":["value"]}'), (3, "{}")]
    q["parse_links"] = with_(
        "SELECT run_id, question_id, CASE WHEN v IN (0, 1, 2, 3) THEN rl.links WHEN v = 5 AND links_json NOT LIKE '%[]%' THEN rl.links "
        "WHEN v = 7 THEN odd.links ELSE '{}' END AS links FROM asked JOIN rl USING (f, tn) JOIN odd USING (f) "
        "WHERE db_key IN (SELECT db_key FROM docs)",
        BASE, LINKS, ALL_RUNS, real, f"odd(f, links) AS ({values(parsed_odd)})",
    )
    q["parse_id_links"] = with_(
        "SELECT question_id, rl.links AS links FROM exd JOIN rl USING (f, tn)", BASE, LINKS, real
    )
    known = """
asked_preds AS (SELECT preds.run_id, preds.question_id, preds.pos, preds.links_json, ex.f, ex.tn, ex.db_key,
  (preds.question_id // 12 + preds.run_id) % 8 AS v FROM preds JOIN ex ON ex.question_id = preds.question_id WHERE db_key IN (SELECT db_key FROM docs))
"""
    q["normalize_links"] = with_(
        "SELECT run_id, question_id, pos, CASE WHEN pos = 1 THEN '{}' WHEN v IN (0, 1, 2, 3) THEN rl.links "
        "WHEN v = 5 AND rl.links NOT LIKE '%[]%' THEN rl.links WHEN v = 7 THEN odd.links ELSE '{}' END AS links "
        "FROM asked_preds JOIN rl USING (f, tn) JOIN odd USING (f)",
        BASE, LINKS, ALL_PREDICTIONS, real, known, f"odd(f, links) AS ({values(normal_odd)})",
    )
    q["validate_links"] = with_(
        """, bad AS (
SELECT run_id, question_id, db_id, t AS table_name, NULL AS col_name FROM spoilt WHERE NOT known
UNION ALL SELECT run_id, question_id, db_id, t, c FROM (SELECT *, unnest(cs) AS c FROM spoilt WHERE known) s
WHERE NOT EXISTS (SELECT 1 FROM tcol WHERE tcol.f = s.f AND tcol.table_name = s.t AND tcol.col_name = s.c AND plain_type IS NOT NULL))
SELECT question_id, db_id, table_name, col_name, 'question_id=' || question_id || ' db_id=' || db_id || ': ' || CASE WHEN col_name IS NULL
THEN 'table ''' || table_name || ''' not in schema' ELSE 'column ''' || col_name || ''' not in table ''' || table_name || '''' END AS warning FROM bad""",
        BASE, LINKS, ALL_RUNS,
        """spoilt0 AS (SELECT asked.run_id, question_id, db_id, asked.f, CASE v WHEN 1 THEN upper(table_name) ELSE table_name END AS t,
  CASE WHEN v = 1 THEN list_transform(cols, lambda c: upper(c)) WHEN len(cols) = 0 THEN cols ELSE list_concat(cols, ['no_such_col']) END AS cs
  FROM asked JOIN lt USING (f, tn) WHERE v <> 4 AND db_key IN (SELECT db_key FROM docs)
  UNION ALL SELECT run_id, question_id, db_id, f, 'ghost_table', ['ghost_col'] FROM asked WHERE v = 4 AND db_key IN (SELECT db_key FROM docs)),
spoilt AS (SELECT *, EXISTS (SELECT 1 FROM tcol WHERE tcol.f = spoilt0.f AND table_name = t AND plain_type IS NOT NULL) AS known FROM spoilt0)""",
    ).replace(")\n, bad AS", "),\nbad AS")
    q["canonical_links"] = with_(
        "SELECT run_id, question_id, pos, coalesce(tt, '') AS tables, coalesce(pp, '') AS pairs, bad_tables::INT AS bad_tables, "
        "bad_columns::INT AS bad_columns FROM src JOIN xb USING (id) "
        "LEFT JOIN (SELECT id, string_agg(m, ',' ORDER BY m) AS tt FROM xt GROUP BY id) USING (id) "
        "LEFT JOIN (SELECT id, string_agg(m, ',' ORDER BY m) AS pp FROM xp GROUP BY id) USING (id)",
        BASE, ALL_PREDICTIONS, known,
        "src AS (SELECT *, row_number() OVER () AS id, links_json AS links FROM asked_preds)".replace(
            "row_number() OVER ()", "(question_id * 10 + run_id) * 10 + pos"
        ),
        scorer_rows("src", "x", True),
    )
    q["links_shape"] = with_(
        "SELECT question_id, num_tables, num_columns, num_tables > 1 AS is_multitable, has_empty AS has_empty_columns FROM shape",
        BASE, SHAPES,
    )

    q["last_wins"] = with_("SELECT run_id, question_id, links_json, entries FROM lasts", BASE, ALL_PREDICTIONS, LASTS)
    q["extra_predictions"] = with_(
        "SELECT DISTINCT run_id, question_id FROM preds WHERE question_id NOT IN (SELECT question_id FROM ex)", BASE, ALL_PREDICTIONS
    )
    q["eval_diagnostics"] = with_(
        """SELECT run_id, sum(entries - 1)::BIGINT AS duplicates, count(*) FILTER (status IS NULL) AS extra,
count(*) FILTER (status = 'no_schema') AS unscored_no_schema, count(*) FILTER (status = 'no_gold') AS unscored_no_gold,
count(*) FILTER (status = 'scored') AS scored, (SELECT count(*) FROM st WHERE status = 'scored') AS evaluable,
(SELECT count(*) FROM st WHERE status = 'scored') - count(*) FILTER (status = 'scored') AS missing
FROM lasts LEFT JOIN st USING (question_id) GROUP BY run_id""",
        BASE, PREDICTIONS, LASTS, GOLD,
        "st AS (SELECT question_id, CASE WHEN db_key NOT IN (SELECT db_key FROM docs) THEN 'no_schema' "
        "WHEN question_id NOT IN (SELECT question_id FROM gold) THEN 'no_gold' ELSE 'scored' END AS status FROM ex "
        "UNION ALL SELECT -1 - question_id, 'no_schema' FROM ex WHERE o_totalprice > 492000)",
    )
    per_row = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)
    q["per_question"] = with_(
        f"SELECT run_id, question_id, db_id, {per_row}, bad_tables, bad_columns, is_missing FROM rws", BASE, SCORED
    )
    rest = "questions, missing, bad_tables, bad_columns"
    q["macro_scores"] = with_(f"SELECT run_id, {ROUNDED}, {rest} FROM macro", BASE, SCORED, averages("run_id"))
    q["by_database"] = with_(
        f"SELECT run_id, db_id, {ROUNDED}, {rest} FROM macro", BASE, SCORED, averages("run_id", "db_id")
    )
    runs_too = averages("run_id").replace("av AS", "rav AS").replace("sc1 AS", "rsc AS").replace("FROM av)", "FROM rav)")
    runs_too = runs_too.replace("macro AS", "rmacro AS").replace("FROM sc1)", "FROM rsc)")
    q["scores_by_level"] = with_(
        f"SELECT 'database' AS level, run_id, db_id, {ROUNDED}, {rest} FROM macro "
        f"UNION ALL SELECT 'run', run_id, NULL, {ROUNDED}, {rest} FROM rmacro",
        BASE, SCORED, averages("run_id", "db_id"), runs_too,
    )
    q["hallucinations"] = with_("SELECT run_id, bad_tables, bad_columns FROM macro", BASE, SCORED, averages("run_id"))
    four = lambda c: f"format('{{:.4f}}', {c})"
    lines = [
        "'Evaluated:                  ' || questions || ' questions'",
        "CASE WHEN missing > 0 THEN 'Missing prediction count:   ' || missing || '  (scored as empty)' END",
        "'Schema-invalid identifiers: tables=' || bad_tables || ', columns=' || bad_columns",
        "''",
        "'---- Table-level (macro-averaged across questions) ----'",
        f"'  Precision_T : ' || {four('p_t')}", f"'  Recall_T    : ' || {four('r_t')}", f"'  F1_T        : ' || {four('f1_t')}",
        f"'  Table Score : ' || {four('table_score')} || '     ((P+R+F1)/3)'",
        "''",
        "'---- Column-level (Table.Column pairs, macro-averaged) ----'",
        f"'  Precision_C : ' || {four('p_c')}", f"'  Recall_C    : ' || {four('r_c')}", f"'  F1_C        : ' || {four('f1_c')}",
        f"'  Column Score: ' || {four('column_score')} || '     ((P+R+F1)/3)'",
        "''",
        f"'==> Leaderboard Score : ' || {four('leaderboard_score')} || '   (0.5*Table + 0.5*Column)'",
    ]
    scored = (BASE, SCORED, averages("run_id"))
    q["eval_report"] = with_(f"SELECT run_id, concat_ws(chr(10), {', '.join(lines)}) AS report FROM macro", *scored)
    q["parse_report"] = with_(f"SELECT run_id, {PRINTED} FROM macro", *scored)
    q["leaderboard"] = with_("SELECT * FROM board", *scored, BOARD)
    q["best_run"] = with_(
        "SELECT *, leaderboard_score >= 0.5 AS promote FROM board WHERE status = 'ok' AND leaderboard_score >= 0 "
        "ORDER BY leaderboard_score DESC, adapter_dir LIMIT 1",
        *scored, BOARD,
    )
    q["runs_with_config"] = with_(
        "SELECT run_name, leaderboard_score, 16 * run_id AS lora_r, 100 + 80 * run_id AS max_steps FROM board", *scored, BOARD
    )

    q["db_counts"] = with_("SELECT db_id, count(*) AS n FROM ex GROUP BY db_id", BASE)
    before = "(SELECT *, FALSE AS is_oversampled FROM shape)"
    q["dataset_stats"] = with_(stats("before", before) + " UNION ALL " + stats("after", "balanced"), BASE, BALANCED)
    q["light_balance"] = with_("SELECT question_id, db_id, source, is_oversampled FROM balanced", BASE, BALANCED)
    q["balance_log"] = with_(
        "SELECT db_id, n AS original_count, least(2 * n, 10) AS target_count, least(2 * n, 10) - n AS duplications_added "
        "FROM dbn WHERE n < 10 AND least(2 * n, 10) > n",
        BASE, SHAPES,
    )
    q["train_balance"] = with_(
        """SELECT question_id, db_id, 'original' AS part, 0::BIGINT AS copy FROM ex
UNION ALL SELECT nb.question_id, nb.db_id, 'draw', draw FROM dr JOIN nb ON nb.db_id = dr.db_id AND nb.rn = dr.rn
UNION ALL SELECT question_id, db_id, 'extra', 0 FROM shape WHERE num_tables >= 2""",
        BASE, SHAPES,
        "goal AS (SELECT greatest(18, floor(sum(n) / count(*)))::BIGINT AS target FROM dbn)",
        "nb AS (SELECT question_id, db_id, row_number() OVER (PARTITION BY db_id ORDER BY question_id) AS rn FROM ex)",
        "dn AS (SELECT db_id, n, unnest(range(1, target - n + 1)) AS draw FROM dbn, goal WHERE n < target)",
        f"dr AS (SELECT db_id, draw, {hashed(lit(str(SEED)), 'db_id', 'draw')} % n + 1 AS rn FROM dn)",
    )
    target = f"(db_id IN {tuple(TARGETS['databases'])} OR db_id LIKE '{TARGETS['prefixes'][0]}%')".replace(",)", ")")
    q["target_oversample"] = with_(
        f"SELECT question_id, db_id, unnest(range(CASE WHEN {target} THEN 4 ELSE 1 END))::INT AS copy FROM ex", BASE
    )
    q["seeded_shuffle"] = with_(
        f"SELECT question_id, md5(concat_ws(':', '{SEED}', question_id)) AS shuffle_key FROM ex", BASE
    )
    q["difficulty"] = with_("SELECT * EXCLUDE (o_totalprice) FROM diff", BASE, DIFFICULTY)
    q["select_for_augmentation"] = with_("SELECT * FROM sel", BASE, DIFFICULTY)
    q["selection_by_db"] = with_("SELECT db_id, count(*) AS selected FROM sel GROUP BY db_id", BASE, DIFFICULTY)

    q["parsed_examples"] = with_(
        "SELECT question_id, 0 AS pos, db_id, question, gold_sql, num_tables FROM shape "
        "UNION ALL SELECT question_id, 1, NULL, NULL, NULL, -1 FROM ex",
        BASE, SHAPES,
    )
    q["parsed_questions"] = with_(
        "SELECT 0 AS pos, question_id, db_id, question, CAST(question_id AS VARCHAR) AS question_key FROM ex "
        "UNION ALL SELECT 1, -1, NULL, NULL, 'text:' || question_id FROM ex",
        BASE,
    )
    q["incomplete_examples"] = with_("SELECT question_id, NULL::VARCHAR AS db_id FROM ex", BASE)
    q["parsed_predictions"] = with_(
        "SELECT question_id AS asked, 0 AS pos, TRUE AS is_number, question_id::VARCHAR AS question_key, links_json FROM ex "
        "UNION ALL SELECT question_id, 1, FALSE, 'text:' || question_id, '7' FROM ex "
        "UNION ALL SELECT question_id, 2, TRUE, question_id::VARCHAR, NULL FROM ex",
        BASE,
    )
    q["parsed_runs"] = (
        "SELECT replace(c_name, '#', '_') || '_run' || c_custkey AS run_id, run_id AS run_name, "
        "'/sweeps/' || c_name || '/runs/' || c_custkey || '/checkpoints/final_checkpoint' AS adapter_dir, "
        "c_mktsegment AS base_model FROM customer"
    )
    q["prediction_rows"] = with_("SELECT question_id, links_json AS schema_links FROM ex", BASE)
    q["review_rows"] = with_(
        "SELECT question_id, sel.db_id, n AS db_count, score, reasons, num_tables, num_columns, question, gold_sql "
        "FROM sel JOIN ex USING (question_id)",
        BASE, DIFFICULTY,
    )
    q["selection_rows"] = with_(
        "SELECT question_id, sel.db_id, question, gold_sql, answer AS schema_links, score AS selection_score, "
        "reasons AS selection_reasons, num_tables AS num_linked_tables, num_columns AS num_linked_columns, "
        "n AS original_db_example_count FROM sel JOIN ex USING (question_id) JOIN nj0 USING (f, tn)",
        BASE, DIFFICULTY, norm,
    )

    q["parsed_catalog"] = q["catalog_columns"]
    q["stored_examples"] = with_(
        "SELECT question_id, question_id % 1000 AS pos, db_id, question, gold_sql, answer AS links FROM shape JOIN nj0 USING (f, tn)",
        BASE, SHAPES, norm,
    )
    q["stored_gold"] = with_(
        "SELECT question_id, question_id::VARCHAR AS question_key, CASE WHEN o_totalprice < 10000 THEN '{}' ELSE links_json END AS links_json FROM ex",
        BASE,
    )
    q["stored_stats"] = with_(
        "SELECT 'training' AS split, per.*, tot.* EXCLUDE (stage) FROM (SELECT db_id, count(*) AS n FROM balanced GROUP BY db_id) per, "
        f"({stats('x', 'balanced')}) tot",
        BASE, BALANCED,
    )
    q["stored_splits"] = q["light_balance"]
    q["stored_per_question"] = with_(f"SELECT run_id, question_id, db_id, {per_row} FROM rws", BASE, SCORED)
    q["stored_leaderboard"] = with_(
        "SELECT board.*, coalesce(run_id = first(CASE WHEN status = 'ok' THEN run_id END) OVER "
        "(ORDER BY leaderboard_score DESC, adapter_dir ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) "
        "AND leaderboard_score >= 0.5, FALSE) AS promote FROM board",
        *scored, BOARD,
    )
    q["records_written"] = with_(
        "SELECT count(*) FILTER (question_id % 7 <> 0) AS written, count(*) AS rows, count(*) FILTER (question_id % 7 = 0) AS without_schema FROM ex",
        BASE,
    )

    ids = f"SELECT doc_id, {token_ids('text')} AS ids FROM documents"
    q["token_ids"] = f"SELECT doc_id, len(ids)::INT AS n_ids, md5({text('ids')}) AS ids_md5 FROM ({ids})"
    lengths = "list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: length(w))"
    q["arrow_token_ids"] = (
        f"SELECT doc_id, len(ids)::INT AS n_ids, md5({text('ids')}) AS ids_md5 FROM (SELECT doc_id, {lengths} AS ids FROM documents)"
    )
    q["input_budget"] = f"SELECT doc_id, {text('ids[greatest(1, len(ids) - 255):]')} AS ids FROM ({ids})"
    q["truncate_pair"] = with_(
        f"SELECT question_id, truncated, {text('p')} AS prompt_ids, {text('a')} AS answer_ids FROM pr", BASE, PAIRS
    )
    q["truncation_report"] = with_(
        "SELECT count(*) FILTER (truncated) AS truncated_rows, count(*) AS total_rows FROM pr", BASE, PAIRS
    )
    q["label_mask"] = with_(
        f"SELECT question_id, {text('i')} AS input_ids, {text('m')} AS attention_mask, {text('l')} AS labels FROM mk", BASE, PAIRS
    )
    q["pad_batch"] = with_(
        f"SELECT question_id, batch, {padded('i', 1)} AS input_ids, {padded('m', 0)} AS attention_mask, {padded('l', -100)} AS labels FROM b2",
        BASE, PAIRS,
        f"b1 AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', question_id)), question_id) - 1) // 8 AS batch FROM mk)",
        "b2 AS (SELECT *, max(len(i)) OVER (PARTITION BY batch) AS longest FROM b1)",
    )
    q["shuffle_places"] = with_(
        f"SELECT question_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', question_id)), question_id) AS place FROM ex", BASE
    )
    q["training_sequences"] = with_(
        f"""SELECT question_id, len(p) > 128 - len(a) AS truncated, len(q)::INT + len(a)::INT AS n_ids, md5({text('list_concat(q, a)')}) AS ids_md5, len(q)::INT AS n_masked FROM t2""",
        *payload,
        f"t0 AS (SELECT question_id, {token_ids('pt')} AS p, {token_ids('ans')} AS a0 FROM (SELECT question_id, 'System: ' || {lit(V.SYSTEM_PROMPT_IDS)} || chr(10) || chr(10) "
        "|| 'User: ' || user_text || chr(10) || chr(10) || 'Assistant:' AS pt, ids || '<|endoftext|>' AS ans FROM usr JOIN tgt USING (question_id)))",
        "t1 AS (SELECT question_id, p, CASE WHEN len(a0) >= 128 THEN list_concat(a0[1:127], [0]) ELSE a0 END AS a FROM t0)",
        "t2 AS (SELECT *, CASE WHEN 128 - len(a) <= 0 THEN [] ELSE p[greatest(1, len(p) - (128 - len(a)) + 1):] END AS q FROM t1)",
    )
    q["questions_without_schema"] = with_(
        "SELECT -1 - question_id AS question_id, 'lost ' || db_id AS db_id FROM ex WHERE o_totalprice > 492000", BASE
    )
    q["predict_by_size"] = (
        "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '\\w+|[^\\w\\s]'))::INT AS n_tokens, md5(coalesce(text, '')) AS response FROM documents"
    )
    q["batch_predict"] = with_("SELECT question_id, question, 'echo ' || question AS response FROM ex", BASE)
    q["link_questions"] = with_(
        "SELECT question_id, '{\"' || table_name || '\":[\"' || col_name || '\"]}' AS links FROM cand JOIN sent USING (question_id) "
        "WHERE t_rank = 1 AND c_rank = 1 + length(array_to_string(parts[-least(len(parts), "
        f"{INPUT_LENGTH}):], '')) % 2",
        BASE, SCORES, free, user_text("ids"),
        f"sent AS (SELECT question_id, regexp_extract_all(prompt, '\\s*(?:[0-9A-Za-z_]+|[^0-9A-Za-z_\\s])') AS parts FROM ({prompt('ids')}))",
    )
    return q
