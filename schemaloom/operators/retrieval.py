"""Candidate schemas: score, rank, expand along foreign keys, prune, number.

After the join with the catalog a question's whole schema sits in its row, so
every step here is a narrow expression on that row: nothing is exploded,
shuffled or grouped again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.config import RetrievalConfig
from schemaloom.functions import tokens as tok
from schemaloom.functions.arrays import any_of, choose, inline_rows, let, take
from schemaloom.functions.links import fold_links
from schemaloom.operators.catalog import db_key, linking_tables
from schemaloom.operators.joins import BROADCAST_COLUMNS, hot_key_join, join_catalog


def question_features(question: Column) -> Column:
    """Tokens, folded text and hints of a question, worked out once."""
    return let(
        tok.question_tokens(question),
        lambda words: F.struct(
            words.alias("words"),
            tok.word_bag(words).alias("bag"),
            tok.word_mask(words).alias("mask"),
            F.lower(question).alias("lc"),
            tok.compact(question).alias("compact"),
            tok.asks_for(words, V.DATE_HINT).alias("date"),
            tok.asks_for(words, V.COUNT_HINT).alias("count"),
            tok.asks_for(words, V.AVERAGE_HINT).alias("average"),
        ),
    )


def _overlap(q: Column, item: Column) -> Column:
    shared = F.size(F.filter(item.words, lambda w: q.bag.contains(w))) / item.norm
    return choose(q.mask.bitwiseAND(item.mask) == 0, F.lit(0.0), shared)


def _hits(q: Column, item: Column) -> Column:
    return tok.name_hits(q.lc, q.compact, item.plain, item.short)


def column_score(q: Column, c: Column) -> Column:
    """The order of the additions is part of the result: ties compare bits."""
    score = F.lit(V.COLUMN_OVERLAP_WEIGHT) * _overlap(q, c) + _hits(q, c)
    hinted = score + tok.bonus(q.date & c.has_date, V.DATE_HINT[0])
    hinted = hinted + tok.bonus(q["count"] & c.has_count, V.COUNT_HINT[0])
    hinted = hinted + tok.bonus(q.average & c.has_average, V.AVERAGE_HINT[0])
    return choose(c.has_date | c.has_count | c.has_average, hinted, score) + c.key_bonus


def table_total(overlap: Column, hits: Column, top: Column) -> Column:
    """A table's score from its name's weighed overlap and hits, and the scores of its best columns."""
    best = F.lit(V.BEST_COLUMN_WEIGHT) * F.coalesce(F.get(top, F.lit(0)), F.lit(0.0))
    return overlap + hits + best + F.lit(V.TOP_COLUMNS_WEIGHT) * F.aggregate(top, F.lit(0.0), lambda acc, s: acc + s)


def table_score(q: Column, t: Column, scores: Column) -> Column:
    return let(
        take(F.sort_array(scores, asc=False), V.TOP_COLUMNS),
        lambda top: table_total(F.lit(V.TABLE_OVERLAP_WEIGHT) * _overlap(q, t), _hits(q, t), top),
    )


def scored_table(q: Column, t: Column) -> Column:
    """The score of a table and those of its columns."""
    return let(
        F.transform(t.columns, lambda c: column_score(q, c)),
        lambda scores: F.struct(
            table_score(q, t, scores).alias("score"),
            t.name_lc,
            (-t.table_idx).alias("back"),
            t.table_idx,
            scores.alias("scores"),
        ),
    )


def scored_tables(q: Column, tables: Column) -> Column:
    """Scores of all tables and their columns, in schema order.

    Only numbers and the sort name are kept; everything else stays in `tables`
    at the same position. The first three fields are what tables are ranked by.
    """
    return F.transform(tables, lambda t: scored_table(q, t))


def with_scores(
    questions: DataFrame, catalog: DataFrame, columns: int | None = None, stored: bool = False
) -> DataFrame:
    """Questions with `tables`, the schema of their database, and its `scored`.

    `catalog` holds schema documents, or with `stored` a `linking_catalog`.
    """
    derive = None if stored else {"tables": linking_tables()}
    asked = questions.withColumn("db_key", db_key(F.col("db_id")))
    scored = let(question_features(F.col("question")), lambda q: scored_tables(q, F.col("tables")))
    return join_catalog(asked, catalog, columns, derive).withColumn("scored", scored)


def with_scores_once(
    questions: DataFrame, catalog: DataFrame, columns: int | None = None, stored: bool = False
) -> DataFrame:
    """The same rows as `with_scores`, where a question asked again to the same database is scored once.

    Distinct pairs of database and question are scored and joined back to all
    who asked, by a shuffle in which a question with very many rows is split.
    What moves back are the scores; a broadcast schema joins once more where
    the rows are, one that is not comes with the scores.
    """
    asked = questions.withColumn("db_key", db_key(F.col("db_id"))).withColumn("_asked", F.struct("db_key", "question"))
    counts = asked.groupBy("_asked").agg(F.count(F.lit(1)).alias("n"))
    derive = None if stored else {"tables": linking_tables()}
    attach = lambda rows, by: join_catalog(rows, catalog, columns, derive, by)
    scores = let(question_features(F.col("question")), lambda q: scored_tables(q, F.col("tables"))).alias("scored")
    distinct = attach(counts.select("_asked", "_asked.*"), "question")
    small = columns is not None and columns <= BROADCAST_COLUMNS
    scored = distinct.select("_asked", scores) if small else distinct.select("_asked", "tables", scores)
    back = hot_key_join(asked, scored, "_asked", "question_id", counts=counts).drop("_asked")
    return attach(back, "question_id") if small else back


def questions_without_schema(questions: DataFrame, catalog: DataFrame, columns: int | None = None) -> DataFrame:
    """Questions that retrieval drops, because no schema has their `db_key`."""
    asked = questions.withColumn("db_key", db_key(F.col("db_id")))
    return join_catalog(asked, catalog.select("db_key"), columns, how="left_anti")


def column_scores(scored: DataFrame) -> DataFrame:
    """One row per question and column."""
    rows = F.flatten(
        F.transform(
            "tables",
            lambda t: F.transform(
                t.columns,
                lambda c, j: F.struct(
                    t.table_idx,
                    t["name"].alias("table_name"),
                    c.col_idx,
                    c["name"].alias("col_name"),
                    F.get(F.get(F.col("scored"), t.table_idx).scores, j).alias("score"),
                ),
            ),
        )
    )
    return inline_rows(scored, rows, "col_idx", "question_id")


def table_scores(scored: DataFrame) -> DataFrame:
    """One row per question and table."""
    rows = F.transform(
        "tables",
        lambda t: F.struct(
            t.table_idx,
            t["name"].alias("table_name"),
            F.get(F.col("scored"), t.table_idx).score.alias("score"),
        ),
    )
    return inline_rows(scored, rows, "table_idx", "question_id")


def ranked_tables(scored: Column) -> Column:
    """Table positions: score down, lower-case name down, schema order."""
    return F.transform(F.sort_array(scored, asc=False), lambda t: t.table_idx)


def table_names(positions: Column, tables: Column) -> Column:
    return F.transform(positions, lambda i: F.get(tables, i)["name"])


def topk_tables(scored: DataFrame, k: int) -> DataFrame:
    """The k best tables of each question with their rank."""
    ranked = F.transform(
        take(ranked_tables(F.col("scored")), k),
        lambda i, rank: F.struct(
            (rank + 1).alias("t_rank"),
            F.get(F.col("tables"), i)["name"].alias("table_name"),
            F.get(F.col("scored"), i).score.alias("score"),
        ),
    )
    return inline_rows(scored, ranked, "t_rank", "question_id")


def forced_tables(tables: Column, chosen: Column, force: Column) -> Column:
    """Positions of forced tables that were not chosen, in schema order."""
    missing = F.filter(
        tables,
        lambda t: F.exists(force, lambda f: f.table_lc == t.name_lc) & ~F.array_contains(chosen, t.table_idx),
    )
    return F.transform(missing, lambda t: t.table_idx)


def join_neighbours(tables: Column, order: Column, chosen: Column, seeds: int, limit: int) -> Column:
    """Chosen tables plus, seed by seed, their best neighbours not yet in."""

    def added(acc: Column, near: Column) -> Column:
        new = take(F.filter(order, lambda n: F.array_contains(near, n) & ~F.array_contains(acc, n)), limit)
        return choose(F.size(near) == 0, acc, F.concat(acc, new))

    return F.aggregate(
        take(chosen, seeds),
        chosen,
        lambda acc, seed: let(F.get(tables, seed).neighbours, lambda near: added(acc, near)),
    )


def choose_tables(tables: Column, order: Column, cfg: RetrievalConfig, force: Column | None) -> Column:
    """Positions of the candidate tables in candidate order.

    Forced tables and neighbours may go beyond the table budget.
    """
    top = take(order, cfg.max_tables)
    if force is not None:
        top = let(top, lambda best: F.concat(best, forced_tables(tables, best, force)))
    if not cfg.include_join_neighbors:
        return top
    return let(top, lambda best: join_neighbours(tables, order, best, cfg.max_tables, cfg.join_neighbor_limit))


def _is_forced(force: Column, t: Column, c: Column) -> Column:
    return F.exists(force, lambda f: (f.table_lc == t.name_lc) & F.array_contains(f.cols_lc, c.name_lc))


def prune_columns(t: Column, scores: Column, cfg: RetrievalConfig, force: Column | None) -> Column:
    """The columns that fit the budget and all forced ones, in schema order."""
    forced = lambda c: [] if force is None else [_is_forced(force, t, c).alias("forced")]
    # Scores may be costly, and are only needed where there is something to cut.
    keys = lambda s: F.transform(
        t.columns,
        lambda c, j: F.struct(
            *forced(c),
            F.get(s, j).alias("score"),
            (c.is_pk | c.is_fk).alias("key"),
            c.name_lc,
            (-j).alias("back"),
        ),
    )
    kept = F.transform(take(F.sort_array(let(scores, keys), asc=False), cfg.columns_kept), lambda k: -k.back)
    cut = let(
        kept,
        lambda best: F.filter(t.columns, lambda c, j: any_of([F.array_contains(best, j), *forced(c)])),
    )
    return choose(F.size(t.columns) <= cfg.columns_kept, t.columns, cut)


def numbered_columns(columns: Column) -> Column:
    return F.transform(
        columns,
        lambda c, j: F.struct(
            (j + 1).alias("c_rank"),
            F.concat(F.lit("C"), (j + 1).cast("string")).alias("column_id"),
            c["name"].alias("col_name"),
            c.name_lc,
            c.col_type,
            c.is_pk,
            c.is_fk,
        ),
    )


def numbered_tables(
    tables: Column, chosen: Column, scores: Callable[[Column], Column], cfg: RetrievalConfig, force: Column | None = None
) -> Column:
    """Chosen tables with IDs `T1, T2, …` and pruned columns `C1, C2, …`; `scores` gives those of a table's columns."""
    return F.transform(
        chosen,
        lambda i, rank: let(
            F.get(tables, i),
            lambda t: F.struct(
                (rank + 1).alias("t_rank"),
                F.concat(F.lit("T"), (rank + 1).cast("string")).alias("table_id"),
                t["name"].alias("table_name"),
                t.name_lc,
                numbered_columns(prune_columns(t, scores(i), cfg, force)).alias("columns"),
            ),
        ),
    )


def candidates(tables: Column, scored: Column, cfg: RetrievalConfig, force: Column | None = None) -> Column:
    """Candidate tables with IDs `T1, T2, …` and columns `C1, C2, …` in each."""

    def build(s: Column, chosen: Column) -> Column:
        return numbered_tables(tables, chosen, lambda i: F.get(s, i).scores, cfg, force)

    return let(
        scored,
        lambda s: let(
            ranked_tables(s),
            lambda order: let(choose_tables(tables, order, cfg, force), lambda chosen: build(s, chosen)),
        ),
    )


def candidate_schema(
    questions: DataFrame,
    catalog: DataFrame,
    cfg: RetrievalConfig,
    columns: int | None = None,
    force_links: str | None = None,
    stored: bool = False,
) -> DataFrame:
    """Questions with their `candidates`; questions without a schema drop out.

    `force_links` names a `map<string,array<string>>` column whose tables and
    columns always become candidates: for training data only, so that a
    target never points at a hidden identifier.
    """
    scored = with_scores(questions, catalog, columns, stored)
    make = lambda force: candidates(F.col("tables"), F.col("scored"), cfg, force)
    made = make(None) if force_links is None else let(fold_links(F.col(force_links)), make)
    return scored.withColumn("candidates", made).drop("scored")


def explode_candidates(df: DataFrame) -> DataFrame:
    """One row per candidate column; a table without columns gives one row."""
    tables = inline_rows(df, "candidates", "t_rank", "question_id").drop("name_lc")
    return tables.select(
        "question_id", "t_rank", "table_id", "table_name", F.inline_outer("columns")
    ).drop("name_lc")


def candidates_by_budget(scored: DataFrame, budgets: dict[str, RetrievalConfig]) -> DataFrame:
    """Scored questions with their `candidates` under each named `budget`, scored only once."""
    made = [
        F.struct(F.lit(name).alias("budget"), candidates(F.col("tables"), F.col("scored"), cfg).alias("candidates"))
        for name, cfg in budgets.items()
    ]
    return scored.select("*", F.inline(F.array(*made)))


def retrieval_recall(df: DataFrame, links: str, *keys: str) -> DataFrame:
    """Share of linked tables and columns that survive the budgets, per question.

    `keys` are kept beside the question, such as the name of a budget.

    Links outside the schema count as lost. Questions without linked columns
    have a null column recall.
    """
    wanted = fold_links(F.col(links))

    def found(row: Column) -> Column:
        def table(f: Column) -> Column:
            hit = F.try_element_at(F.filter(row.candidates, lambda t: t.name_lc == f.table_lc), F.lit(1))
            return let(
                hit,
                lambda t: F.struct(
                    t.isNotNull().alias("table"),
                    F.size(f.cols_lc).alias("wanted"),
                    F.coalesce(
                        F.size(
                            F.filter(
                                f.cols_lc, lambda c: F.exists(t.columns, lambda x: x.name_lc == c)
                            )
                        ),
                        F.lit(0),
                    ).alias("columns"),
                ),
            )

        return F.transform(row.wanted, table)

    total = lambda arr, pick: F.aggregate(arr, F.lit(0), lambda acc, x: acc + pick(x))
    hits = let(F.struct(F.col("candidates"), wanted.alias("wanted")), found)
    counted = df.select(
        *keys,
        "question_id",
        "db_id",
        let(
            hits,
            lambda h: F.struct(
                F.size(h).alias("gold_tables"),
                total(h, lambda x: x.table.cast("int")).alias("found_tables"),
                total(h, lambda x: x.wanted).alias("gold_columns"),
                total(h, lambda x: x["columns"]).alias("found_columns"),
            ),
        ).alias("r"),
    )
    return counted.select(
        *keys,
        "question_id",
        "db_id",
        "r.*",
        F.try_divide("r.found_tables", "r.gold_tables").alias("table_recall"),
        F.try_divide("r.found_columns", "r.gold_columns").alias("column_recall"),
    )
