"""One query per operator, over whole tables. Lists leave as joined text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.config import PRESETS, RetrievalConfig, RunConfig
from schemaloom.functions import jsontext, prompts, sequences, tokens
from schemaloom.functions import links as link_text
from schemaloom.functions.arrays import inline_rows, let
from schemaloom.operators import bucketed, budgets, catalog, curate, evaluate, indexed, joins, links, predict, retrieval
from schemaloom.operators import sequences as seq_ops
from schemaloom.plans import jobs
from schemaloom.sources import folders, readers, settings, writers
from workloads import inputs
from workloads import templates as X

Query = Callable[[SparkSession, str], DataFrame]

# Small budgets, so that every pruning rule has something to prune.
BUDGET = RetrievalConfig(
    max_tables=2, max_columns_per_table=4, min_columns_per_table=2, join_neighbor_limit=1
)
MAX_LENGTH = 20
INPUT_LENGTH = 60
SEED = 43
# The order of examples in their input.
INPUT_ORDER = ("o_totalprice", "question_id")
TARGETS = {"databases": ("corpus Customer#000000001",), "prefixes": ("field survey/2024",)}

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


class Data:
    """The inputs of one call."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(inputs, name)(self.spark, self.sf)

    def table(self, name: str) -> DataFrame:
        return inputs.table(self.spark, self.sf, name)

    def size(self) -> int:
        return catalog.catalog_size(self.schema_docs)


def joined(arr: str | Column) -> Column:
    return F.array_join(F.col(arr) if isinstance(arr, str) else arr, ",")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Catalog ------------------------------------------------------------------


@query
def db_keys(spark, sf):
    d = Data(spark, sf)
    return d.customers.select("c_custkey", "db_id", catalog.db_key(F.col("db_id")).alias("db_key"))


@query
def catalog_columns(spark, sf):
    return catalog.catalog_columns(Data(spark, sf).schema_docs)


@query
def catalog_columns_source_keys(spark, sf):
    df = catalog.catalog_columns(Data(spark, sf).schema_docs, fk_ends="source")
    return df.select("db_key", "col_idx", "is_pk", "is_fk")


@query
def catalog_tables(spark, sf):
    return catalog.catalog_tables(Data(spark, sf).schema_docs)


@query
def fk_edges(spark, sf):
    return catalog.fk_edges(Data(spark, sf).schema_docs)


@query
def schema_map(spark, sf):
    df = catalog.schema_map(Data(spark, sf).schema_docs)
    rows = inline_rows(df, F.map_entries("schema"), "key", "db_key")
    return rows.select("db_key", F.col("key").alias("table_name"), joined("value").alias("cols"))


@query
def schema_lookup(spark, sf):
    return catalog.schema_lookup(catalog.catalog_columns(Data(spark, sf).schema_docs))


@query
def columns_by_table(spark, sf):
    return catalog.columns_by_table(Data(spark, sf).schema_docs)


@query
def full_schema_text(spark, sf):
    text = prompts.serialize_full_schema(catalog.sorted_tables())
    return Data(spark, sf).schema_docs.select("db_key", text.alias("schema_text"))


# Tokens and lexical evidence ------------------------------------------------


@query
def identifier_tokens(spark, sf):
    df = catalog.catalog_columns(Data(spark, sf).schema_docs)
    return df.select("db_key", "col_idx", joined(tokens.split_identifier(F.col("col_name"))).alias("tokens"))


@query
def question_tokens(spark, sf):
    df = Data(spark, sf).questions
    return df.select("question_id", joined(tokens.question_tokens(F.col("question"))).alias("tokens"))


@query
def document_tokens(spark, sf):
    words = tokens.question_tokens(F.col("text"))
    df = Data(spark, sf).table("documents").select("doc_id", words.alias("words"))
    return df.select("doc_id", F.size("words").alias("n_tokens"), F.md5(joined("words")).alias("tokens_md5"))


@query
def text_word_counts(spark, sf):
    d = Data(spark, sf)
    count = tokens.word_count(F.col("text")).alias("n_words")
    return (
        d.table("documents")
        .select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), count)
        .unionByName(
            d.table("conversations").select(
                F.lit("conversations").alias("source"),
                F.col("conv_id").alias("id"),
                F.col("turn").cast("int").alias("turn"),
                count,
            )
        )
    )


@query
def lexical_evidence(spark, sf):
    """Every score part of every question and column, each on its own."""
    d = Data(spark, sf)
    column = F.struct(
        "col_idx",
        "col_name",
        "is_pk",
        "is_fk",
        tokens.split_identifier(F.col("col_name")).alias("name_words"),
    )
    columns = catalog.catalog_columns(d.schema_docs).groupBy("db_key").agg(F.collect_list(column).alias("columns"))
    asked = d.questions.select(
        "question_id",
        catalog.db_key(F.col("db_id")).alias("db_key"),
        "question",
        tokens.question_tokens(F.col("question")).alias("words"),
    )
    pairs = joins.join_catalog(asked, columns, d.size()).select("question_id", "question", "words", F.inline("columns"))
    return rounded(
        pairs.select(
            "question_id",
            "col_idx",
            tokens.token_overlap(F.col("words"), F.col("name_words")).alias("overlap"),
            tokens.substring_score(F.col("question"), F.col("col_name")).alias("substring"),
            tokens.operator_hints(F.col("words"), F.col("col_name")).alias("hints"),
            tokens.key_bonus(F.col("is_pk"), F.col("is_fk")).alias("key_bonus"),
        ),
        "overlap",
        "hints",
    )


@query
def sql_features(spark, sf):
    sql = F.col("gold_sql")
    return Data(spark, sf).examples.select(
        "question_id",
        tokens.join_count(sql).alias("joins"),
        tokens.sql_contains(sql, V.GROUP_ORDER_FRAGMENTS).alias("groups_or_orders"),
        tokens.sql_contains(sql, V.AGGREGATE_FRAGMENTS).alias("aggregates"),
        tokens.sql_contains(sql, V.SUBQUERY_FRAGMENTS).alias("has_subquery"),
        tokens.word_count(F.col("question")).alias("question_words"),
    )


# Retrieval --------------------------------------------------------------------


def _scored(d: Data) -> DataFrame:
    return retrieval.with_scores(d.questions, d.schema_docs, d.size())


@query
def column_scores(spark, sf):
    df = retrieval.column_scores(_scored(Data(spark, sf)))
    return rounded(df.select("question_id", "col_idx", "score"), "score")


@query
def table_scores(spark, sf):
    return rounded(retrieval.table_scores(_scored(Data(spark, sf))), "score")


@query
def topk_tables(spark, sf):
    return rounded(retrieval.topk_tables(_scored(Data(spark, sf)), 3), "score")


@query
def forced_tables(spark, sf):
    """Linked tables that the two best tables leave out, in the order they are added."""
    d = Data(spark, sf)
    scored = retrieval.with_scores(d.linked_examples, d.schema_docs, d.size())
    best = F.slice(retrieval.ranked_tables(F.col("scored")), 1, BUDGET.max_tables)
    missing = let(
        F.struct(best.alias("best"), link_text.fold_links(F.col("schema_links")).alias("force")),
        lambda x: retrieval.table_names(
            retrieval.forced_tables(F.col("tables"), x.best, x.force), F.col("tables")
        ),
    )
    rows = scored.select("question_id", F.posexplode_outer(missing).alias("place", "table_name"))
    return rows.where("place is not null")


@query
def join_neighbours(spark, sf):
    """The two best tables and the neighbours they bring in."""
    scored = _scored(Data(spark, sf))
    tables = F.col("tables")
    chosen = let(
        retrieval.ranked_tables(F.col("scored")),
        lambda order: retrieval.table_names(
            retrieval.join_neighbours(tables, order, F.slice(order, 1, 2), 2, 1), tables
        ),
    )
    return scored.select("question_id", joined(chosen).alias("chosen"))


@query
def candidate_schema(spark, sf):
    d = Data(spark, sf)
    return retrieval.explode_candidates(
        retrieval.candidate_schema(d.questions, d.schema_docs, BUDGET, d.size())
    )


@query
def forced_candidate_schema(spark, sf):
    d = Data(spark, sf)
    df = retrieval.candidate_schema(d.linked_examples, d.schema_docs, BUDGET, d.size(), "schema_links")
    return retrieval.explode_candidates(df).select(
        "question_id", "t_rank", "table_name", "c_rank", "col_name"
    )


@query
def retrieval_recall(spark, sf):
    """What two budgets keep of the linked tables and columns."""
    d = Data(spark, sf)
    scored = retrieval.with_scores(d.linked_examples, d.schema_docs, d.size())
    both = retrieval.candidates_by_budget(scored, {"small": BUDGET, "grid": PRESETS["grid"]})
    return rounded(retrieval.retrieval_recall(both, "schema_links", "budget"), "table_recall", "column_recall")


@query
def questions_without_schema(spark, sf):
    d = Data(spark, sf)
    lost = retrieval.questions_without_schema(d.scored_questions, d.schema_docs, d.size())
    return lost.select("question_id", "db_id")


@query
def topk_tables_repeated(spark, sf):
    """Each distinct question is scored once, however often it is asked."""
    d = Data(spark, sf)
    scored = retrieval.with_scores_once(d.repeated_questions, d.schema_docs, d.size())
    return rounded(retrieval.topk_tables(scored, 3), "score")


@query
def topk_tables_indexed(spark, sf):
    d = Data(spark, sf)
    return rounded(indexed.topk_tables(d.questions, indexed.indexed_catalog(d.schema_docs), 3, d.size()), "score")


@query
def topk_tables_bucketed(spark, sf):
    """The same from questions and schemas that were stored in equal buckets, one database split."""
    d, path = Data(spark, sf), folders.work_folder(spark, "buckets")
    name = "bucketed_" + path.rsplit("-", 1)[1]
    bucketed.publish(d.questions, d.schema_docs, name, path, buckets=8, rows_per_salt=20)
    return rounded(retrieval.topk_tables(bucketed.with_scores(spark, name), 3), "score")


@query
def candidate_schema_indexed(spark, sf):
    d = Data(spark, sf)
    index = indexed.indexed_catalog(d.schema_docs, late=True)
    made = indexed.candidate_schema(d.questions, index, BUDGET, d.size())
    return retrieval.explode_candidates(made)


# Prompts and targets -----------------------------------------------------------


def _payloads(spark, sf, output_format: str | list[str], force: bool = True) -> DataFrame:
    d = Data(spark, sf)
    return jobs.example_payloads(d.linked_examples, d.schema_docs, BUDGET, output_format, force, d.size())


@query
def prompt_ids(spark, sf):
    d = Data(spark, sf)
    return jobs.prompts(d.questions, d.schema_docs, BUDGET, "ids", d.size()).select("question_id", "prompt")


@query
def prompt_names(spark, sf):
    d = Data(spark, sf)
    return jobs.prompts(d.questions, d.schema_docs, BUDGET, "names", d.size()).select("question_id", "prompt")


@query
def prompts_by_run(spark, sf):
    """Prompts under the budgets and answer formats of four runs, from one scoring."""
    d = Data(spark, sf)
    df = budgets.prompts_by_run(d.questions, d.schema_docs, d.run_settings, d.size())
    return df.select("run_id", "question_id", F.md5("prompt").alias("prompt_md5"))


@query
def example_payloads(spark, sf):
    return _payloads(spark, sf, "ids")


@query
def target_json(spark, sf):
    """Answers over candidates without the gold forced in, as IDs and as names."""
    return _payloads(spark, sf, ["ids", "names"], force=False).select("question_id", "output_format", "assistant")


@query
def chat_rows(spark, sf):
    df = jobs.chat_rows(_payloads(spark, sf, "ids"))
    turns = F.concat("prompt", "completion")
    return df.select("question_id", "db_id", F.posexplode_outer(turns).alias("turn", "message")).select(
        "question_id", "db_id", "turn", "message.role", "message.content"
    )


@query
def normalized_json(spark, sf):
    text = link_text.normalized_json(F.col("schema_links"))
    return Data(spark, sf).linked_examples.select("question_id", text.alias("answer"))


def _records(spark, sf) -> DataFrame:
    d = Data(spark, sf)
    return jobs.sft_records(d.linked_examples, d.schema_docs, columns=d.size())


@query
def sft_records(spark, sf):
    message = lambda i, part: F.get("messages", F.lit(i))[part]
    return _records(spark, sf).select(
        "question_id",
        "db_id",
        message(0, "content").alias("system"),
        message(1, "content").alias("user"),
        message(2, "content").alias("assistant"),
        "source",
        "num_tables",
        "num_columns",
        "is_multitable",
        "has_empty_columns",
        "is_oversampled",
    )


# JSON and links --------------------------------------------------------------------


def _entries(text: Column) -> Column:
    pairs = jsontext.entries_last_wins(jsontext.unwrap_links(jsontext.first_json_object(text)))
    return F.transform(
        pairs,
        lambda p: F.struct(p.key.alias("key"), F.array_join(jsontext.string_items(p.value), ",").alias("names")),
    )


@query
def first_json(spark, sf):
    """Keys and names of the first object in each answer."""
    df = Data(spark, sf).responses
    return inline_rows(df, _entries(F.col("response")), "key", "run_id", "question_id")


@query
def event_props(spark, sf):
    """The same on the properties of events."""
    found = jsontext.first_json_object(F.col("props"))
    pairs = F.transform(
        jsontext.entries_last_wins(found),
        lambda p: F.struct(p.key.alias("key"), jsontext.text_or_none(p.value).alias("value")),
    )
    return inline_rows(Data(spark, sf).table("events"), pairs, "key", "event_id")


@query
def parse_links(spark, sf):
    d = Data(spark, sf)
    # Candidates are made once per question and then meet the answers of all runs.
    offered = retrieval.candidate_schema(d.examples, d.schema_docs, BUDGET, d.size())
    df = links.parse_links(inputs.with_responses(offered), "response")
    return df.select("run_id", "question_id", link_text.compact_json(F.col("parsed")).alias("links"))


@query
def parse_id_links(spark, sf):
    """The target answers given as IDs, read back to names."""
    d = Data(spark, sf)
    offered = retrieval.candidate_schema(d.linked_examples, d.schema_docs, BUDGET, d.size(), "schema_links")
    answer = link_text.target_json(
        F.col("schema_links"), F.col("candidates"), F.col("tables"), "ids"
    )
    df = links.parse_links(offered.withColumn("response", F.lower(answer)), "response")
    return df.select("question_id", link_text.compact_json(F.col("parsed")).alias("links"))


def _predicted(d: Data) -> DataFrame:
    """Predictions of asked questions with their database."""
    return d.all_predictions.join(d.questions.select("question_id", "db_id"), "question_id")


@query
def normalize_links(spark, sf):
    d = Data(spark, sf)
    df = links.normalize_links(_predicted(d), d.schema_docs, "links_json", d.size())
    return df.select("run_id", "question_id", "pos", link_text.compact_json(F.col("normalized")).alias("links"))


@query
def validate_links(spark, sf):
    d = Data(spark, sf)
    answered = inputs.all_pairs_of_runs(d.examples)
    text = F.when(F.col("v") == 1, F.upper("links_json")).when(
        F.col("v") == 4, F.lit('{"ghost_table":["ghost_col"]}')
    )
    spoilt = F.replace("links_json", F.lit('"]'), F.lit('","no_such_col"]'))
    answered = answered.select(
        "run_id",
        "question_id",
        "db_id",
        F.from_json(F.coalesce(text, spoilt), link_text.LINKS_TYPE).alias("schema_links"),
    )
    return links.validate_links(answered, d.schema_docs, "schema_links", d.size())


@query
def canonical_links(spark, sf):
    d = Data(spark, sf)
    df = links.canonical_links(_predicted(d), d.schema_docs, "links_json", d.size())
    pairs = F.transform("canonical.pairs", lambda p: F.replace(p, F.lit(link_text.PAIR_SEPARATOR), F.lit(".")))
    return df.select(
        "run_id",
        "question_id",
        "pos",
        joined(F.array_sort("canonical.tables")).alias("tables"),
        joined(F.array_sort(pairs)).alias("pairs"),
        "canonical.bad_tables",
        "canonical.bad_columns",
    )


@query
def links_shape(spark, sf):
    df = links.links_shape(Data(spark, sf).linked_examples, "schema_links")
    return df.select("question_id", "num_tables", "num_columns", "is_multitable", "has_empty_columns")


# Scoring -----------------------------------------------------------------------------


@query
def last_wins(spark, sf):
    return evaluate.last_wins(Data(spark, sf).all_predictions)


@query
def extra_predictions(spark, sf):
    d = Data(spark, sf)
    return evaluate.extra_predictions(d.all_predictions, d.questions)


@query
def eval_diagnostics(spark, sf):
    d = Data(spark, sf)
    return evaluate.eval_diagnostics(d.scored_questions, d.gold, d.predictions, d.schema_docs, d.size())


def _rows(spark, sf) -> DataFrame:
    d = Data(spark, sf)
    return evaluate.per_question(d.scored_questions, d.gold, d.predictions, d.schema_docs, list(X.RUNS), d.size())


SCORES = ("table_score", "column_score", "leaderboard_score")


@query
def per_question(spark, sf):
    return rounded(_rows(spark, sf), *evaluate.METRICS)


@query
def macro_scores(spark, sf):
    return rounded(evaluate.macro_scores(_rows(spark, sf)), *evaluate.METRICS, *SCORES)


@query
def by_database(spark, sf):
    return rounded(evaluate.by_database(_rows(spark, sf)), *evaluate.METRICS, *SCORES)


@query
def scores_by_level(spark, sf):
    """Runs and their databases from one scoring."""
    return rounded(evaluate.scores_by_level(_rows(spark, sf)), *evaluate.METRICS, *SCORES)


@query
def hallucinations(spark, sf):
    return evaluate.hallucinations(_rows(spark, sf))


@query
def eval_report(spark, sf):
    return evaluate.eval_report(evaluate.macro_scores(_rows(spark, sf)))


@query
def parse_report(spark, sf):
    reports = evaluate.eval_report(evaluate.macro_scores(_rows(spark, sf)))
    return evaluate.parse_report(reports).drop("report")


def _board(spark, sf) -> DataFrame:
    return evaluate.leaderboard(evaluate.macro_scores(_rows(spark, sf)), Data(spark, sf).runs)


@query
def leaderboard(spark, sf):
    return _board(spark, sf)


@query
def best_run(spark, sf):
    return evaluate.best_run(_board(spark, sf), min_score=0.5)


@query
def runs_with_config(spark, sf):
    """Scores beside the settings of each run."""
    d = Data(spark, sf)
    configs = d.runs.select(
        "run_id",
        (F.lit(16) * F.col("run_id")).alias("lora_r"),
        (F.lit(100) + 80 * F.col("run_id")).alias("max_steps"),
    )
    return evaluate.runs_with_config(_board(spark, sf), configs).select(
        "run_name", "leaderboard_score", "lora_r", "max_steps"
    )


# Curation ----------------------------------------------------------------------------------


@query
def db_counts(spark, sf):
    return curate.db_counts(Data(spark, sf).examples)


@query
def dataset_stats(spark, sf):
    """Totals of the examples before and after light balancing."""
    balanced = curate.light_balance(Data(spark, sf).ordered_examples, order=INPUT_ORDER)
    # Originals count in both.
    stages = F.array_compact(F.array(F.lit("after"), F.when(~F.col("is_oversampled"), F.lit("before"))))
    both = curate.dataset_stats(balanced.withColumn("stage", F.explode(stages)), "stage")
    return rounded(both, "avg_tables_per_example", "avg_columns_per_example")


@query
def light_balance(spark, sf):
    df = curate.light_balance(Data(spark, sf).ordered_examples, order=INPUT_ORDER)
    return df.select("question_id", "db_id", "source", "is_oversampled")


@query
def balance_log(spark, sf):
    return curate.balance_log(Data(spark, sf).examples)


@query
def train_balance(spark, sf):
    df = curate.train_balance(Data(spark, sf).linked_examples, SEED)
    return df.select("question_id", "db_id", "part", "copy")


@query
def target_oversample(spark, sf):
    df = curate.target_oversample(Data(spark, sf).examples, 3, **TARGETS)
    return df.select("question_id", "db_id", "copy")


@query
def seeded_shuffle(spark, sf):
    df = curate.seeded_shuffle(Data(spark, sf).questions, SEED, ["question_id"])
    return df.select("question_id", curate.shuffle_key(SEED, F.col("question_id")).alias("shuffle_key"))


def _difficulty(spark, sf) -> DataFrame:
    return curate.difficulty(Data(spark, sf).ordered_examples)


def _selection(df: DataFrame) -> DataFrame:
    return df.select(
        "question_id", "db_id", "n", "score", F.concat_ws(";", "reasons").alias("reasons"), "num_tables", "num_columns"
    )


@query
def shuffle_places(spark, sf):
    """The place of every example in the seeded order."""
    return curate.numbered_shuffle(Data(spark, sf).examples.select("question_id"), SEED, ["question_id"])


@query
def difficulty(spark, sf):
    return _selection(_difficulty(spark, sf))


@query
def select_for_augmentation(spark, sf):
    return _selection(curate.select_for_augmentation(_difficulty(spark, sf), order=INPUT_ORDER))


@query
def selection_by_db(spark, sf):
    return curate.selection_by_db(curate.select_for_augmentation(_difficulty(spark, sf), order=INPUT_ORDER))


# Texts of files in, rows of files out ----------------------------------------------------------


@query
def parsed_examples(spark, sf):
    """Each example as a list of two entries, the second one with its id only."""
    entry = F.to_json(F.struct("question_id", "db_id", "question", "gold_sql", "schema_links"))
    text = F.concat(F.lit("["), entry, F.lit(', {"question_id": '), F.col("question_id"), F.lit("}]"))
    rows = Data(spark, sf).linked_examples.select(F.posexplode(readers.example_rows(text)).alias("pos", "row"))
    return rows.select(
        "row.question_id",
        "pos",
        "row.db_id",
        "row.question",
        "row.gold_sql",
        F.coalesce(link_text.table_count(F.col("row.schema_links")), F.lit(-1)).alias("num_tables"),
    )


@query
def parsed_questions(spark, sf):
    """Each question as a list of two entries, the second one under its id as a text."""
    entry = F.to_json(F.struct("question_id", "db_id", "question"))
    again = F.format_string('{"question_id": "%d", "question": null}', "question_id")
    text = F.concat(F.lit("["), entry, F.lit(","), again, F.lit("]"))
    rows = Data(spark, sf).questions.select(F.posexplode(readers.question_rows(text)).alias("pos", "row"))
    return rows.select("pos", "row.*").fillna(-1, "question_id")


@query
def incomplete_examples(spark, sf):
    """Entries of the lists of `parsed_examples` that lack a field."""
    entry = F.to_json(F.struct("question_id", "db_id", "question", "gold_sql", "schema_links"))
    text = F.concat(F.lit("["), entry, F.lit(', {"question_id": '), F.col("question_id"), F.lit("}]"))
    rows = Data(spark, sf).linked_examples.select(F.inline(readers.example_rows(text)))
    return readers.incomplete_examples(rows).select("question_id", "db_id")


@query
def parsed_predictions(spark, sf):
    """A number, a text and a missing `schema_links` under the id of each question."""
    form = '[{"question_id": %d, "schema_links": %s}, {"question_id": "%d", "schema_links": 7}, {"question_id": %d}]'
    qid = F.col("question_id")
    text = F.format_string(form, qid, F.col("links_json"), qid, qid)
    rows = Data(spark, sf).examples.select(
        qid.alias("asked"), F.posexplode(readers.links_rows(text)).alias("pos", "row")
    )
    return rows.select(
        "asked",
        "pos",
        (F.col("row.question_id") == F.col("asked")).alias("is_number"),
        "row.question_key",
        F.col("row.schema_links").alias("links_json"),
    ).fillna(False, "is_number")


@query
def parsed_runs(spark, sf):
    """A run of the grid for each customer."""
    path = F.format_string(
        "file:///sweeps/%s/runs/%d/checkpoints/final_checkpoint/adapter_config.json", F.col("c_name"), F.col("c_custkey")
    )
    value = F.to_json(F.struct(F.col("c_mktsegment").alias("base_model_name_or_path")))
    return readers.run_rows(Data(spark, sf).customers.select(path.alias("path"), value.alias("value")), "grid")


@query
def parsed_settings(spark, sf):
    """A settings file for each customer, with keys that are unknown, null or absent."""
    value = F.format_string(
        '{"seed": 1, "output_format": "%s", "retrieval": {"max_tables": %d, "join_neighbor_limit": null, "depth": 2}, "train_config": {"r": %d}}',
        F.when(F.col("family") == 0, "NAMES").otherwise("ids"), F.col("c_custkey") % 30, F.col("c_custkey"),
    )
    path = F.format_string("file:///sweeps/%d/run_config.json", F.col("c_custkey"))
    rows = settings.settings_rows(Data(spark, sf).customers.select(path.alias("path"), value.alias("value")))
    return rows.select("adapter_dir", "output_format", "max_input_length", "train_config", "retrieval.*")


@query
def prediction_rows(spark, sf):
    """Lines of predictions whose links are those of the examples."""
    parsed = F.transform(
        F.map_entries("schema_links"), lambda e: F.struct(e.key.alias("table_name"), e.value.alias("cols"))
    )
    rows = writers.prediction_rows(Data(spark, sf).linked_examples.withColumn("parsed", parsed))
    return rows.select("question_id", F.to_json("schema_links").alias("schema_links"))


@query
def review_rows(spark, sf):
    return writers.review_rows(curate.select_for_augmentation(_difficulty(spark, sf), order=INPUT_ORDER))


@query
def selection_rows(spark, sf):
    df = writers.selection_rows(curate.select_for_augmentation(_difficulty(spark, sf), order=INPUT_ORDER))
    return df.withColumns(
        {
            "schema_links": link_text.normalized_json(F.col("schema_links")),
            "selection_reasons": F.concat_ws(";", "selection_reasons"),
        }
    )


# Files written by one job and read by the next ---------------------------------------------------


@query
def parsed_catalog(spark, sf):
    """Columns of the schema files of all customers; positions in them are numbers, names are text."""
    d = Data(spark, sf)
    path = F.concat(F.lit("file:///schemas/"), catalog.db_key(F.col("db_id")), F.lit(".json"))
    files = d.customers.select(path.alias("path"), inputs.document_text().alias("value"))
    return catalog.catalog_columns(readers.document_rows(files))


@query
def stored_examples(spark, sf):
    """Examples as JSON lines with their place."""
    path = folders.work_folder(spark, "examples")
    writers.write_jsonl(Data(spark, sf).linked_examples.withColumn("pos", F.col("question_id") % 1000), path)
    rows = readers.complete_examples(readers.read_example_lines(spark, path))
    links = link_text.normalized_json(F.col("schema_links")).alias("links")
    return rows.select("question_id", "pos", "db_id", "question", "gold_sql", links)


@query
def stored_gold(spark, sf):
    """Gold as JSON lines; cheap orders have a later entry that is empty."""
    path = folders.work_folder(spark, "gold")
    rows = Data(spark, sf).ordered_examples
    first = rows.select("question_id", "schema_links", F.lit(0).alias("pos"))
    nothing = F.map_filter("schema_links", lambda k, v: F.lit(False))
    later = rows.where("o_totalprice < 10000").select("question_id", nothing, F.lit(1))
    writers.write_jsonl(first.union(later), path)
    return readers.read_gold_lines(spark, path)


@query
def stored_stats(spark, sf):
    """Counts per database of the balanced examples, beside the totals of their split."""
    path = folders.work_folder(spark, "stats")
    records = curate.light_balance(Data(spark, sf).ordered_examples, order=INPUT_ORDER)
    writers.write_stats(records, "training", path)
    totals, counts = readers.read_stats(spark, path)
    return rounded(counts.join(totals, "split"), "avg_tables_per_example", "avg_columns_per_example")


@query
def stored_splits(spark, sf):
    """Original and balanced records out of their folders."""
    path = folders.work_folder(spark, "splits")
    writers.write_splits(curate.light_balance(Data(spark, sf).ordered_examples, order=INPUT_ORDER), path)
    return readers.read_splits(spark, path, "question_id bigint, db_id string, is_oversampled boolean")


@query
def stored_per_question(spark, sf):
    """The table of scores per question and run, out of its file."""
    path = folders.work_folder(spark, "per_question")
    writers.write_per_question(_rows(spark, sf), path)
    rows = readers.read_per_question(spark, path).withColumn("run_id", F.col("run_id").cast("int"))
    return rounded(rows, *evaluate.METRICS)


@query
def stored_leaderboard(spark, sf):
    """The leaderboard out of its file, with the run that the other file names as the best one."""
    path = folders.work_folder(spark, "board")
    writers.write_leaderboard(_board(spark, sf), f"{path}/all")
    board = readers.read_leaderboard(spark, f"{path}/all")
    writers.write_best_run(evaluate.best_run(board, min_score=0.5), f"{path}/best")
    best = readers.read_best_run(spark, f"{path}/best").select("run_id", "promote")
    return board.join(best, "run_id", "left").withColumn("run_id", F.col("run_id").cast("int")).fillna(False, "promote")


@query
def records_written(spark, sf):
    """What the pass that writes the training records counts: all examples, and those whose database has no schema."""
    d = Data(spark, sf)
    examples, path = d.linked_examples, folders.work_folder(spark, "records")
    lost = F.when(F.col("question_id") % 7 == 0, F.concat(F.lit("lost "), "db_id")).otherwise(F.col("db_id"))
    seen = Observation()
    records = jobs.sft_records(examples.withColumn("db_id", lost), d.schema_docs, columns=d.size(), observed=seen)
    writers.write_jsonl(records, path, "gzip")
    written = readers.read_splits(spark, path, "question_id bigint").agg(F.count(F.lit(1)).alias("written"))
    return written.select("written", *[F.lit(seen.get[c]).cast("bigint").alias(c) for c in ("rows", "without_schema")])


# Sequences and prediction ---------------------------------------------------------------------


def _pairs(spark, sf) -> DataFrame:
    return Data(spark, sf).examples.select(
        "question_id",
        sequences.hashed_token_ids(F.col("question")).alias("prompt_ids"),
        sequences.hashed_token_ids(F.col("links_json")).alias("answer_ids"),
    )


@query
def token_ids(spark, sf):
    """Ids of whole documents."""
    ids = sequences.hashed_token_ids(F.col("text"))
    df = Data(spark, sf).table("documents").select("doc_id", ids.alias("ids"))
    return df.select("doc_id", F.size("ids").alias("n_ids"), F.md5(joined("ids")).alias("ids_md5"))


def word_lengths():
    """A tokenizer for the Arrow path: each word becomes its length."""
    return lambda texts: [[len(word) for word in text.split()] for text in texts]


@query
def arrow_token_ids(spark, sf):
    ids = sequences.tokenizer_ids(F.col("text"), word_lengths)
    df = Data(spark, sf).table("documents").select("doc_id", ids.alias("ids"))
    return df.select("doc_id", F.size("ids").alias("n_ids"), F.md5(joined("ids")).alias("ids_md5"))


@query
def input_budget(spark, sf):
    ids = sequences.input_budget(sequences.hashed_token_ids(F.col("text")), 256)
    return Data(spark, sf).table("documents").select("doc_id", joined(ids).alias("ids"))


@query
def truncate_pair(spark, sf):
    df = seq_ops.truncate_pair(_pairs(spark, sf), MAX_LENGTH, eos_id=0)
    return df.withColumns({"prompt_ids": joined("prompt_ids"), "answer_ids": joined("answer_ids")})


@query
def truncation_report(spark, sf):
    return seq_ops.truncation_report(seq_ops.truncate_pair(_pairs(spark, sf), MAX_LENGTH, eos_id=0))


def _masked(spark, sf) -> DataFrame:
    fitted = seq_ops.truncate_pair(_pairs(spark, sf), MAX_LENGTH, eos_id=0).drop("truncated")
    return seq_ops.label_mask(fitted)


IDS = ("input_ids", "attention_mask", "labels")


@query
def label_mask(spark, sf):
    return _masked(spark, sf).withColumns({c: joined(c) for c in IDS})


@query
def pad_batch(spark, sf):
    batched = seq_ops.assign_batches(_masked(spark, sf), "question_id", 8, SEED)
    return seq_ops.pad_batch(batched, pad_id=1).withColumns({c: joined(c) for c in IDS})


@query
def training_sequences(spark, sf):
    """Payloads of all examples as fitted token rows."""
    df = jobs.training_sequences(_payloads(spark, sf, "ids"), 128, "<|endoftext|>", eos_id=0)
    return df.select(
        "question_id",
        "truncated",
        F.size("input_ids").alias("n_ids"),
        F.md5(joined("input_ids")).alias("ids_md5"),
        F.size(F.filter("labels", lambda x: x == V.IGNORED_LABEL)).alias("n_masked"),
    )


def first_choice():
    """A stand-in model: the first column of the first table, or the second if the prompt's length is odd."""
    return lambda prompts: [f'Answer: {{"t1": ["C{1 + len(p) % 2}"]}}' for p in prompts]


@query
def batch_predict(spark, sf):
    d = Data(spark, sf)
    return predict.batch_predict(d.questions.select("question_id", "question"), "question", echo)


def digests():
    """A stand-in model: the MD5 of each prompt."""

    def model(prompts: list[str]) -> list[str]:
        from hashlib import md5

        return [md5(p.encode()).hexdigest() for p in prompts]

    return model


@query
def predict_by_size(spark, sf):
    """Whole documents as prompts, in batches of at most 4,096 padded tokens."""
    docs = Data(spark, sf).table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = docs.withColumn("n_tokens", sequences.token_count(F.col("text")))
    return predict.batch_predict(asked, "text", digests, 4096, F.col("n_tokens")).drop("text")


def echo():
    return lambda prompts: ["echo " + p for p in prompts]


@query
def link_questions(spark, sf):
    d = Data(spark, sf)
    run = RunConfig(retrieval=BUDGET, max_input_length=INPUT_LENGTH)
    df = jobs.link_questions(d.questions, d.schema_docs, run, first_choice, d.size())
    return df.select("question_id", link_text.compact_json(F.col("parsed")).alias("links"))
