"""Whole jobs: linking questions, training payloads, records, sequences, scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.config import RetrievalConfig, RunConfig
from schemaloom.functions import links as L
from schemaloom.functions import prompts as P
from schemaloom.functions import sequences as seq
from schemaloom.operators import curate, evaluate
from schemaloom.operators import sequences as S
from schemaloom.operators.catalog import sorted_tables
from schemaloom.operators.links import links_shape, parse_links, with_catalog
from schemaloom.operators.observed import counted, kept_rows
from schemaloom.operators.predict import Predictor, batch_predict
from schemaloom.operators.retrieval import candidate_schema
from schemaloom.sources.readers import complete_examples

Tokens = Callable[[Column], Column]
Shorten = Callable[[Column, int], Column]


def prompts(
    questions: DataFrame, catalog: DataFrame, cfg: RetrievalConfig, output_format: str, columns: int | None
) -> DataFrame:
    """Questions with candidates and the inference prompt."""
    offered = candidate_schema(questions, catalog, cfg, columns)
    user = P.user_content(F.col("question"), F.col("candidates"), cfg, output_format)
    return offered.withColumn("prompt", P.prompt_text(P.system_prompt(output_format), user))


def link_questions(
    questions: DataFrame,
    catalog: DataFrame,
    run: RunConfig,
    load: Callable[[], Predictor],
    columns: int | None = None,
    shorten: Shorten = seq.last_tokens,
    tokens_per_batch: int | None = None,
) -> DataFrame:
    """Questions to links with a user's model: retrieve, cut to the input length, ask, parse.

    `shorten` gives the end of a prompt that has so many tokens; for a model
    with a tokenizer of its own, give one that counts by it. Questions without
    a schema are listed by `questions_without_schema`. `tokens_per_batch`
    bounds the padded size of what the model gets at once.
    """
    asked = prompts(questions, catalog, run.retrieval, run.output_format, columns)
    asked = asked.withColumn("prompt", shorten(F.col("prompt"), run.max_input_length))
    answered = batch_predict(asked, "prompt", load, tokens_per_batch)
    return parse_links(answered, "response").select("question_id", "db_id", "response", "parsed")


def example_payloads(
    examples: DataFrame,
    catalog: DataFrame,
    cfg: RetrievalConfig,
    output_format: str | Sequence[str] = "ids",
    force_gold: bool = True,
    columns: int | None = None,
) -> DataFrame:
    """System, user and assistant text of each example, in each output format.

    With `force_gold` the linked tables and columns always are candidates.
    Several formats are made from one scoring.
    """
    offered = candidate_schema(
        examples, catalog, cfg, columns, force_links="schema_links" if force_gold else None
    )

    def payload(name: str) -> Column:
        answer = L.target_json(F.col("schema_links"), F.col("candidates"), F.col("tables"), name)
        return F.struct(
            P.system_prompt(name).alias("system"),
            P.user_content(F.col("question"), F.col("candidates"), cfg, name).alias("user"),
            F.coalesce(answer, F.lit("")).alias("assistant"),
            F.lit(name).alias("output_format"),
        )

    formats = [output_format] if isinstance(output_format, str) else output_format
    return offered.select("question_id", "db_id", "question", F.inline(F.array(*map(payload, formats))))


def chat_rows(payloads: DataFrame) -> DataFrame:
    """Payloads as prompt and completion messages."""
    split = P.prompt_and_completion(F.col("system"), F.col("user"), F.col("assistant"))
    return payloads.select("question_id", "db_id", split.alias("row")).select("question_id", "db_id", "row.*")


def sft_records(
    examples: DataFrame,
    docs: DataFrame,
    include_types: bool = True,
    include_keys: bool = True,
    columns: int | None = None,
    observed: Observation | None = None,
) -> DataFrame:
    """Chat records with the whole schema in the prompt, and their sizes.

    The schema text is made once per database, not once per example.
    Examples without a schema drop out; `observed`, if given, counts them as
    `without_schema` among all `rows` while the records are written.
    """
    text = {"schema_text": P.serialize_full_schema(sorted_tables(), include_types, include_keys)}
    shaped = links_shape(examples, "schema_links")
    if observed is None:
        joined = with_catalog(shaped, docs, columns, text)
    else:
        found = with_catalog(shaped, docs, columns, text | {"_found": F.lit(True)}, how="left")
        joined = kept_rows(found, "without_schema", F.col("_found").isNull(), observed)
    messages = P.chat_messages(
        F.lit(V.SFT_SYSTEM_PROMPT),
        P.full_prompt(F.col("schema_text"), F.col("question")),
        L.normalized_json(F.col("schema_links")),
    )
    return joined.select(
        messages.alias("messages"),
        "question_id",
        "db_id",
        F.lit("original").alias("source"),
        "num_tables",
        "num_columns",
        "is_multitable",
        "has_empty_columns",
        F.lit(False).alias("is_oversampled"),
        "schema_links",
    )


def training_sequences(
    payloads: DataFrame,
    max_length: int,
    eos_text: str = "<|endoftext|>",
    eos_id: int = 0,
    tokens: Tokens = seq.hashed_token_ids,
    observed: Observation | None = None,
) -> DataFrame:
    """Payloads to fitted and labelled token rows; `observed` counts those that were cut as `truncated`.

    Ids by hash stand for their tokens one by one, so prompts are fitted as
    tokens and only those that stay are hashed.
    """
    prompt = P.prompt_text(F.col("system"), F.col("user"))
    by_hash = tokens is seq.hashed_token_ids
    ids = payloads.select(
        "question_id",
        (seq.token_texts(prompt) if by_hash else tokens(prompt)).alias("prompt_ids"),
        tokens(F.concat("assistant", F.lit(eos_text))).alias("answer_ids"),
    )
    fitted = counted(S.truncate_pair(ids, max_length, eos_id), observed, truncated=F.col("truncated"))
    if by_hash:
        fitted = fitted.withColumn("prompt_ids", seq.hashed_ids(F.col("prompt_ids")))
    return S.label_mask(fitted)


def augmentation_candidates(
    examples: DataFrame, min_score: int, max_examples: int | None, order: Sequence[str], observed: Observation | None = None
) -> DataFrame:
    """The hardest examples; an incomplete one stops the job in the pass that reads it.

    `observed` counts the examples with links to more than one table as `multitable`.
    """
    whole = counted(complete_examples(examples), observed, multitable=L.table_count(F.col("schema_links")) > 1)
    return curate.select_for_augmentation(curate.difficulty(whole), min_score, max_examples, order)


def score_runs(
    questions: DataFrame,
    gold: DataFrame,
    predictions: DataFrame,
    docs: DataFrame,
    runs: DataFrame,
    run_ids: list[str | int],
    columns: int | None = None,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """Leaderboard of all runs in one job."""
    rows = evaluate.per_question(questions, gold, predictions, docs, run_ids, columns)
    return evaluate.leaderboard(evaluate.macro_scores(rows), runs, outcomes)


def balanced_training_set(examples: DataFrame, seed: int) -> DataFrame:
    """Balanced examples in a seeded order."""
    return curate.seeded_shuffle(
        curate.train_balance(examples, seed), seed, ["question_id", "part", "copy"]
    )
