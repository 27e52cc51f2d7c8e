"""Prompt and record texts from candidates and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.config import OUTPUT_FORMATS, RetrievalConfig
from schemaloom.functions.arrays import choose, let


def _check(output_format: str) -> bool:
    if output_format not in OUTPUT_FORMATS:
        raise ValueError(f"unsupported output_format: {output_format}")
    return output_format == "ids"


def _suffix(c: Column, cfg: RetrievalConfig) -> Column:
    types, keys = (flag if isinstance(flag, Column) else F.lit(flag) for flag in (cfg.include_types, cfg.include_keys))
    none = F.lit(None).cast("string")
    bits = [
        choose(types & (c.col_type != ""), c.col_type, none),
        choose(keys & c.is_pk, F.lit("PK"), none),
        choose(keys & c.is_fk, F.lit("FK"), none),
    ]
    return let(
        F.concat_ws(" ", *bits), lambda text: choose(text != "", F.concat(F.lit(" ["), text, F.lit("]")), F.lit(""))
    )


def serialize_candidates(candidates: Column, cfg: RetrievalConfig, output_format: str = "ids") -> Column:
    """The candidate schema as text, one line per table and column."""
    ids = _check(output_format)

    def table_head(t: Column) -> Column:
        return F.concat(t.table_id, F.lit(" = "), t.table_name) if ids else F.concat(F.lit("Table: "), t.table_name)

    def column_line(c: Column) -> Column:
        label = F.concat(F.lit("  "), c.column_id, F.lit(" = ")) if ids else F.lit("  - ")
        return F.concat(label, c.col_name, _suffix(c, cfg))

    lines = F.flatten(
        F.transform(
            candidates, lambda t: F.concat(F.array(table_head(t)), F.transform(t.columns, column_line))
        )
    )
    header = V.CANDIDATE_HEADER_IDS if ids else V.CANDIDATE_HEADER_NAMES
    return F.array_join(F.concat(F.array(F.lit(header)), lines), "\n")


def user_content(
    question: Column, candidates: Column, cfg: RetrievalConfig, output_format: str = "ids"
) -> Column:
    instruction = V.INSTRUCTION_IDS if _check(output_format) else V.INSTRUCTION_NAMES
    return F.concat(
        F.lit(instruction + "\n\n"),
        serialize_candidates(candidates, cfg, output_format),
        F.lit("\n\nQuestion:\n"),
        question,
        F.lit("\n\nJSON answer:"),
    )


def system_prompt(output_format: str = "ids") -> Column:
    return F.lit(V.SYSTEM_PROMPT_IDS if _check(output_format) else V.SYSTEM_PROMPT_NAMES)


def prompt_text(system: Column, user: Column) -> Column:
    """Plain prompt for models without a chat form of their own."""
    return F.concat(F.lit("System: "), system, F.lit("\n\nUser: "), user, F.lit("\n\nAssistant:"))


def serialize_full_schema(tables: Column, include_types: bool = True, include_keys: bool = True) -> Column:
    """A whole schema as text; tables and columns come sorted by name."""

    def column_line(c: Column) -> Column:
        line = F.concat(F.lit("  - "), c.col_name)
        if include_types:
            line = F.concat(line, F.lit(" ["), c.col_type, F.lit("]"))
        if include_keys:
            line = F.concat_ws(
                " ",
                line,
                F.when(c.is_pk, F.lit("PRIMARY KEY")),
                F.when(c.is_fk, F.lit("FOREIGN KEY")),
            )
        return line

    lines = F.flatten(
        F.transform(
            tables,
            lambda t: F.concat(
                F.array(F.concat(F.lit("Table: "), t.table_name), F.lit("  Columns:")),
                F.transform(t.columns, column_line),
            ),
        )
    )
    return F.array_join(F.concat(F.array(F.lit("Database schema:")), lines), "\n")


def full_prompt(schema_text: Column, question: Column) -> Column:
    return F.concat(
        F.lit(V.FULL_PROMPT_HEAD), schema_text, F.lit("\n\nQuestion:\n"), question, F.lit("\n\nAnswer:")
    )


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(system: Column, user: Column, assistant: Column) -> Column:
    return F.array(message("system", system), message("user", user), message("assistant", assistant))


def prompt_and_completion(system: Column, user: Column, assistant: Column) -> Column:
    """The split chat form: what the model sees and what it should answer."""
    return F.struct(
        F.array(message("system", system), message("user", user)).alias("prompt"),
        F.array(message("assistant", assistant)).alias("completion"),
    )
