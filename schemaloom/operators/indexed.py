"""The best tables of a question without scoring every column of its schema.

A schema row carries an inverted index of its names: words, the last letters
of names that may occur literally in a question, and hints lead to the tables and columns that have them, each with the most that it can add to their
score. A question looks up its own words and letters, so columns without any
evidence are never touched: their score is their key bonus. What is found adds
up to an upper bound for each table; tables are scored in the order of their
bounds until no bound reaches the worst of the best so far. Tables without any
evidence have a score of their own that is known beforehand.

The index is made inside the schema row and met from the shorter side. Words
and letters of a question are looked up in that of a large schema. That of a
small one has the words, names and hints of each table, which are searched in
the question: tables with evidence are scored without bounds, the others have
the scores that the index holds.

Results are those of `retrieval`, to the last bit. It pays for schemas of many
hundred columns; below that, scoring all of them is as fast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.config import RetrievalConfig
from schemaloom.functions.arrays import any_of, choose, inline_rows, let, take
from schemaloom.operators import retrieval as R
from schemaloom.operators.catalog import db_key, linking_tables
from schemaloom.operators.joins import join_catalog

# Tables and columns are numbered as table * WIDTH + column + 1, and the table itself as + 0.
WIDTH = 1 << 24
# Names of so many letters or more are found by their last ones; shorter names are tried one by one.
GRAMS = (6, 3)
# A question has some hundred letters; a schema with so many tables and columns or less lists its words and names to be searched.
FEW_NAMES = 250
AT = "array<struct<code:bigint,most:double>>"
HINTS = {"date": V.DATE_HINT, "count": V.COUNT_HINT, "average": V.AVERAGE_HINT}
# What an index has of a large or of a small schema only.
INDEX = f"array<array<struct<key:string,at:{AT}>>>"
TINY = "array<struct<plain:string,code:bigint>>"
SORT_KEYS = "array<struct<score:double,name_lc:string,back:int>>"
LISTS = (
    "array<struct<words:array<string>,short:array<string>,plain:array<string>,"
    + "".join(f"{name}:boolean," for name in HINTS)
    + "score:double,scores:array<double>>>"
)
INDEX_COLUMNS = ("index", "grams", "tiny", "idle")
# Bounds are added up in another order than scores.
SLACK = 1 + 1e-9


def _gram(name: Column, mark: str) -> Column:
    """The last letters of a name, as many as the largest gram that it is long enough for."""
    made = F.lit(None).cast("string")
    for n in reversed(GRAMS):
        made = F.when(F.length(name) >= n, F.concat(F.lit(f"{mark}{n}:"), F.right(name, F.lit(n)))).otherwise(made)
    return made


def _postings(tables: Column) -> Column:
    """(`key`, `code`, `most`) of all names of a schema."""

    def of_name(item: Column, code: Column, weight: float) -> Column:
        words = F.transform(
            item.words, lambda w: F.struct(F.concat(F.lit("w:"), F.btrim(w)).alias("key"), code.alias("code"), (F.lit(weight) / item.norm).alias("most"))
        )
        literal = [
            F.when(F.length(name) >= GRAMS[-1], F.struct(_gram(name, mark).alias("key"), code.alias("code"), F.lit(bonus).alias("most")))
            for name, mark, bonus in ((item.plain, "p", V.PLAIN_NAME_BONUS), (item.short, "s", V.COMPACT_NAME_BONUS))
        ]
        return F.concat(words, F.array_compact(F.array(*literal)))

    def of_column(c: Column, code: Column) -> Column:
        hints = [
            F.when(c[f"has_{name}"], F.struct(F.lit("h:" + name).alias("key"), code.alias("code"), F.lit(hint[0]).alias("most")))
            for name, hint in HINTS.items()
        ]
        return F.concat(of_name(c, code, V.COLUMN_OVERLAP_WEIGHT), F.array_compact(F.array(*hints)))

    def of_table(t: Column) -> Column:
        first = t.table_idx.cast("long") * WIDTH
        columns = F.flatten(F.transform(t.columns, lambda c, j: of_column(c, first + j + 1)))
        return F.concat(of_name(t, first, V.TABLE_OVERLAP_WEIGHT), columns)

    return F.flatten(F.transform(tables, of_table))


def _tiny(tables: Column) -> Column:
    """Names too short for a gram: (`plain`, `code`)."""
    short = lambda item, code: F.when(F.length(item.plain) < GRAMS[-1], F.struct(item.plain.alias("plain"), code.alias("code")))

    def of_table(t: Column) -> Column:
        first = t.table_idx.cast("long") * WIDTH
        columns = F.transform(t.columns, lambda c, j: short(c, first + j + 1))
        return F.array_compact(F.concat(F.array(short(t, first)), columns))

    return F.flatten(F.transform(tables, of_table))


def _idle(tables: Column) -> Column:
    """Sort keys of all tables as a question without any evidence ranks them, best first."""

    return F.sort_array(F.transform(tables, lambda t: let(_bonuses(t), lambda s: _sort_key(t, _idle_score(s)))), asc=False)


def _bonuses(t: Column) -> Column:
    """Scores of a table's columns for a question without any evidence."""
    return F.transform(t.columns, lambda c: c.key_bonus)


def _idle_score(bonuses: Column) -> Column:
    top = take(F.sort_array(bonuses, asc=False), V.TOP_COLUMNS)
    return let(top, lambda best: R.table_total(F.lit(0.0), F.lit(0.0), best))


def _sort_key(t: Column, score: Column) -> Column:
    return F.struct(score.alias("score"), t.name_lc, (-t.table_idx).alias("back"))


def _table(tables: Column) -> Column:
    """The hash table of the postings of a schema."""
    size = F.greatest(F.lit(1), F.aggregate(tables, F.lit(0), lambda n, t: n + F.size(t.columns)))

    def placed(postings: Column, places: Column) -> Column:
        place = lambda p: F.pmod(F.xxhash64(p.key), places).cast("int")
        return F.sort_array(F.transform(postings, lambda p: F.struct(place(p).alias("place"), p.key, p.code, p.most)))

    def of_key(x: Column, at: Column) -> Column:
        codes = F.transform(at, lambda i: F.struct(F.get(x, i).code, F.get(x, i).most)).alias("at")
        return let(F.get(x, F.get(at, 0)), lambda first: F.struct(first.place, first.key, codes))

    def table(keyed: Column, places: Column) -> Column:
        # An entry for every place, so that the array has no gaps.
        none = F.lit(None).cast(f"struct<key:string,at:{AT}>").alias("e")
        gaps = F.transform(F.sequence(F.lit(0), places - 1), lambda i: F.struct(i.alias("place"), none))
        filled = F.transform(keyed, lambda x: F.struct(x.place, F.struct(x.key, x["at"]).alias("e")))
        entry = lambda x: lambda i: F.get(x, i).e
        of_place = lambda x, at: F.transform(F.filter(at, lambda i: F.get(x, i).e.isNotNull()), entry(x))
        return _runs(F.sort_array(F.concat(filled, gaps)), "place", of_place)

    return let(
        F.struct(size.alias("size"), _postings(tables).alias("postings")),
        lambda b: let(_runs(placed(b.postings, b.size), "key", of_key), lambda keyed: table(keyed, b.size)),
    )


def _lists(tables: Column) -> Column:
    """For each table its distinct words and names, the hints of its columns, and the scores that it has without evidence."""

    def of_table(t: Column) -> Column:
        of_all = lambda pick: F.concat(F.array(pick(t)), F.transform(t.columns, pick))
        # A question with the plain name has the short one in its compact form, if there is one.
        unshortened = lambda x: choose(x.short.isNull(), x.plain, F.lit(None).cast("string"))
        return let(
            _bonuses(t),
            lambda bonuses: F.struct(
                F.transform(F.array_distinct(F.flatten(of_all(lambda x: x.words))), lambda w: F.btrim(w)).alias("words"),
                F.array_compact(of_all(lambda x: x.short)).alias("short"),
                F.array_compact(of_all(unshortened)).alias("plain"),
                *[F.exists(t.columns, lambda c: c[f"has_{name}"]).alias(name) for name in HINTS],
                _idle_score(bonuses).alias("score"),
                bonuses.alias("scores"),
            ),
        )

    return F.transform(tables, of_table)


def _index(tables: Column) -> Column:
    """`index`, `tiny` names and `idle` ranks of a large schema, or `grams` of a small one."""
    few = F.aggregate(tables, F.size(tables), lambda n, t: n + F.size(t.columns)) <= FEW_NAMES
    none = lambda kind: F.array().cast(kind)
    return let(
        few,
        lambda small: F.struct(
            choose(small, none(INDEX), _table(tables)).alias("index"),
            choose(small, _lists(tables), F.lit(None).cast(LISTS)).alias("grams"),
            choose(small, none(TINY), _tiny(tables)).alias("tiny"),
            choose(small, none(SORT_KEYS), _idle(tables)).alias("idle"),
        ),
    )


def indexed_catalog(docs: DataFrame, stored: bool = False, late: bool = False) -> DataFrame:
    """One row per database: `tables`, the `index` of their names, `tiny` names and `idle` ranks, or few `grams`; a form to store.

    `docs` holds schema documents, or with `stored` a `linking_catalog`. The
    index is a hash table with one place for each column: an array of arrays of
    (`key`, `at`). That of a small schema is in `grams`, one entry for each
    table; it is null in a large schema. With `late` the rows stay documents,
    and the join with the questions makes the index behind its shuffle.
    """
    if late:
        return docs.where("db_key is not null")
    rows = docs if stored else docs.select("db_key", linking_tables().alias("tables"))
    made = _index(F.col("tables")).alias("made")
    return rows.where("db_key is not null").select("db_key", "tables", made).select("db_key", "tables", "made.*")


def _join_indexed(questions: DataFrame, indexed: DataFrame, columns: int | None) -> DataFrame:
    asked = questions.withColumn("db_key", db_key(F.col("db_id")))
    if "index" in indexed.columns:
        return join_catalog(asked, indexed, columns)
    made = let(linking_tables(), lambda tables: F.struct(tables.alias("tables"), _index(tables).alias("made")))
    joined = join_catalog(asked, indexed, columns, {"_made": made})
    return joined.select("*", "_made.tables", "_made.made.*").drop("_made")


def _grams(text: Column, mark: str) -> Column:
    def of(n: int) -> Column:
        starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}:"), F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.concat(*map(of, GRAMS)))


def _keys(q: Column) -> Column:
    words = F.transform(q.words, lambda w: F.concat(F.lit("w:"), w))
    hints = F.array_compact(F.array(*[F.when(q[name], F.lit("h:" + name)) for name in HINTS]))
    return F.concat(words, hints)


def _found(q: Column) -> Column:
    """(`code`, `most`) of all evidence for a question in a large schema, in the order of the codes."""
    index = F.col("index")

    def looked_up(key: Column) -> Column:
        entries = F.get(index, F.pmod(F.xxhash64(key), F.size(index)).cast("int"))
        return F.flatten(F.transform(F.filter(entries, lambda e: e.key == key), lambda e: e["at"]))

    tiny = F.transform(
        F.filter(F.col("tiny"), lambda x: q.lc.contains(x.plain)),
        lambda x: F.struct(x.code.alias("code"), F.lit(V.PLAIN_NAME_BONUS).alias("most")),
    )
    literal = F.transform(F.concat(_grams(q.lc, "p"), _grams(q.compact, "s")), looked_up)
    return F.sort_array(F.concat(F.flatten(F.transform(_keys(q), looked_up)), F.flatten(literal), tiny))


def _runs(rows: Column, of: str, body) -> Column:
    """`body` of every run of structs with an equal field `of`; `rows` are in its order.

    `body` gets all rows and the positions of the run: a slice of an array costs more than its elements.
    """

    def cut(x: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(x, i)[of] != F.get(x, i - 1)[of])
        starts = choose(F.size(x) > 0, F.filter(F.sequence(F.lit(0), F.size(x) - 1), first), F.array().cast("array<int>"))
        return let(
            F.struct(x.alias("x"), starts.alias("s")),
            lambda b: F.transform(
                b.s, lambda start, k: body(b.x, F.sequence(start, F.coalesce(F.get(b.s, k + 1), F.size(b.x)) - 1))
            ),
        )

    return let(rows, cut)


def _bounds(found: Column) -> Column:
    """(`bound`, `back`) of every table with evidence, largest bound first."""

    def of_code(x: Column, at: Column) -> Column:
        most = F.aggregate(at, F.lit(0.0), lambda a, i: a + F.get(x, i).most)
        return let(
            F.struct(F.get(x, F.get(at, 0)).code.alias("code"), most.alias("most")),
            lambda c: F.struct(F.floor(c.code / WIDTH).cast("int").alias("table"), (c.code % WIDTH == 0).alias("own"), c.most),
        )

    def of_table(x: Column, at: Column) -> Column:
        # The code of a table comes before those of its columns.
        head = F.get(x, F.get(at, 0))
        own = choose(head.own, head.most, F.lit(0.0))
        bonus = [F.lit(V.KEY_BONUS)] * V.TOP_COLUMNS
        found_in = F.transform(F.filter(at, lambda i: ~F.get(x, i).own), lambda i: F.get(x, i).most + V.KEY_BONUS)
        tops = F.sort_array(F.concat(found_in, F.array(*bonus)), asc=False)
        most = let(take(tops, V.TOP_COLUMNS), lambda top: R.table_total(own, F.lit(0.0), top))
        return F.struct((most * SLACK).alias("bound"), (-head.table).alias("back"))

    return F.sort_array(_runs(_runs(found, "code", of_code), "table", of_table), asc=False)


def _scored(q: Column, t: Column) -> Column:
    scores = F.transform(t.columns, lambda c: R.column_score(q, c))
    return let(scores, lambda s: _sort_key(t, R.table_score(q, t, s)))


def _none() -> Column:
    return F.struct(F.array().cast(SORT_KEYS).alias("best"), F.lit(0).alias("scored"))


def _best(q: Column, tables: Column, idle: Column, bounds: Column, k: int) -> Column:
    """The k best sort keys and the number of columns that were scored for them."""
    def step(state: Column, x: Column) -> Column:
        done = (F.size(state.best) >= k) & (x.bound < F.get(state.best, k - 1).score)
        t = F.get(tables, -x.back)
        more = F.struct(
            take(F.sort_array(F.concat(state.best, F.array(_scored(q, t))), asc=False), k).alias("best"),
            (state.scored + F.size(t.columns)).alias("scored"),
        )
        return choose(done, state, more)

    def with_idle(state: Column) -> Column:
        hit = F.transform(bounds, lambda x: x.back)
        # Of the first k + hits idle tables at least k are not hit.
        head = F.filter(take(idle, F.size(bounds) + k), lambda x: ~F.array_contains(hit, x.back))
        return F.struct(take(F.sort_array(F.concat(state.best, head), asc=False), k).alias("best"), state.scored.alias("scored"))

    return F.aggregate(bounds, _none(), step, with_idle)


def _touched(q: Column, lists: Column) -> Column:
    """For each table of a small schema whether it has evidence for a question."""

    def of_table(x: Column) -> Column:
        named = F.exists(x.short, lambda n: q.compact.contains(n)) | F.exists(x.plain, lambda n: q.lc.contains(n))
        hit = any_of([F.arrays_overlap(x.words, q.words), *[q[name] & x[name] for name in HINTS], named])
        # A table with a missing name is scored.
        return F.coalesce(hit, F.lit(True))

    return F.transform(lists, of_table)


def _scored_touched(q: Column, tables: Column, lists: Column, touched: Column) -> Column:
    """`retrieval.scored_tables` of a small schema; tables without evidence have the scores of the index."""
    idle = lambda t, x: F.struct(x.score, t.name_lc, (-t.table_idx).alias("back"), t.table_idx, x.scores)
    return F.transform(tables, lambda t, i: choose(F.get(touched, i), R.scored_table(q, t), idle(t, F.get(lists, i))))


def _best_in_small(q: Column, tables: Column, lists: Column, k: int) -> Column:
    keys = lambda scored: F.transform(scored, lambda t: F.struct(t.score, t.name_lc, t.back))
    work = lambda hit: F.aggregate(tables, F.lit(0), lambda n, t: choose(F.get(hit, t.table_idx), n + F.size(t.columns), n))
    return let(
        _touched(q, lists),
        lambda hit: F.struct(
            take(F.sort_array(keys(_scored_touched(q, tables, lists, hit)), asc=False), k).alias("best"), work(hit).alias("scored")
        ),
    )


def _best_in_large(q: Column, tables: Column, k: int) -> Column:
    return let(_bounds(_found(q)), lambda b: _best(q, tables, F.col("idle"), b, k))


def with_best_tables(
    questions: DataFrame, indexed: DataFrame, k: int, columns: int | None = None, keep: bool = False
) -> DataFrame:
    """Questions with `best`, the sort keys of their k best tables, and `scored_columns`, the work done for it.

    `indexed` is an `indexed_catalog` and `columns` the measured size of it.
    The schema, `tables`, stays if `keep` is set.
    """
    joined = _join_indexed(questions, indexed, columns)
    # No question finds as much as an empty one.
    question = F.coalesce("question", F.lit(""))
    tables, lists = F.col("tables"), F.col("grams")
    best = lambda q: choose(lists.isNull(), _best_in_large(q, tables, k), _best_in_small(q, tables, lists, k))
    found = let(R.question_features(question), best) if k > 0 else _none()
    out = joined.withColumn("_found", found).withColumns({"best": F.col("_found.best"), "scored_columns": F.col("_found.scored")})
    return out.drop("_found", *INDEX_COLUMNS, *([] if keep else ["tables"]))


def topk_tables(questions: DataFrame, indexed: DataFrame, k: int, columns: int | None = None) -> DataFrame:
    """The k best tables of each question with their rank: `retrieval.topk_tables`."""
    best = with_best_tables(questions, indexed, k, columns, keep=True)
    ranked = F.transform(
        "best",
        lambda x, rank: F.struct(
            (rank + 1).alias("t_rank"), F.get(F.col("tables"), -x.back)["name"].alias("table_name"), x.score.alias("score")
        ),
    )
    return inline_rows(best, ranked, "t_rank", "question_id")


def candidate_schema(
    questions: DataFrame, indexed: DataFrame, cfg: RetrievalConfig, columns: int | None = None
) -> DataFrame:
    """Questions with their `candidates`: `retrieval.candidate_schema`.

    Beyond the best tables only their neighbours are scored.
    """
    joined = _join_indexed(questions, indexed, columns)
    tables, lists = F.col("tables"), F.col("grams")

    def made(q: Column, top: Column) -> Column:
        near = F.array_distinct(F.flatten(F.transform(top, lambda i: F.get(tables, i).neighbours)))
        keys = F.sort_array(F.transform(near, lambda i: _scored(q, F.get(tables, i))), asc=False)
        order = F.transform(keys, lambda x: -x.back)
        chosen = top
        if cfg.include_join_neighbors:
            chosen = let(order, lambda o: R.join_neighbours(tables, o, top, cfg.max_tables, cfg.join_neighbor_limit))
        scores = lambda i: F.transform(F.get(tables, i).columns, lambda c: R.column_score(q, c))
        return let(chosen, lambda c: R.numbered_tables(tables, c, scores, cfg))

    def of_question(q: Column) -> Column:
        best = _best_in_large(q, tables, cfg.max_tables) if cfg.max_tables > 0 else _none()
        in_large = let(F.transform(best.best, lambda x: -x.back), lambda top: made(q, top))
        in_small = let(_touched(q, lists), lambda hit: R.candidates(tables, _scored_touched(q, tables, lists, hit), cfg))
        return choose(lists.isNull(), in_large, in_small)

    candidates = let(R.question_features(F.coalesce("question", F.lit(""))), of_question)
    return joined.withColumn("candidates", candidates).drop(*INDEX_COLUMNS)
