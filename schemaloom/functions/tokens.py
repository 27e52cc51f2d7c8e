"""Lexical evidence: tokens of identifiers and questions, and their scores."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.functions.arrays import choose, contains_any, let

# A gap between a lower-case letter or digit and an upper-case letter.
CAMEL_GAP = r"(?<=[a-z0-9])(?=[A-Z])"
WORD = r"[a-z0-9]+"
NOT_WORD = r"[^a-z0-9]+"


def is_stopword(word: Column) -> Column:
    return word.isin(*V.STOPWORDS)


def drop_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~is_stopword(w))


def split_identifier(text: Column) -> Column:
    """Lower-case words of a name or sentence, each plural followed by its stem.

    Camel case is opened up; everything but ASCII letters and digits separates.
    A stem is kept even when it is a stopword.
    """
    opened = F.regexp_replace(text, CAMEL_GAP, " ")
    words = drop_stopwords(F.regexp_extract_all(F.lower(opened), F.lit(WORD), F.lit(0)))
    plural = lambda w: w.endswith("s") & (F.length(w) > 3)
    return F.flatten(
        F.transform(
            words,
            lambda w: choose(plural(w), F.array(w, F.left(w, F.length(w) - 1)), F.array(w)),
        )
    )


def expand_synonyms(tokens: Column) -> Column:
    """Each token followed by the sorted words it can stand for (one step)."""
    expansions = {word: [word, *others] for word, others in V.synonyms().items()}
    # As one JSON literal the table is folded to a constant when the plan is made.
    lookup = F.from_json(F.lit(json.dumps(expansions)), "map<string,array<string>>")
    # A look-up in a map walks over its keys, so only words that are there are looked up.
    return F.flatten(
        F.transform(tokens, lambda t: choose(t.isin(*expansions), F.try_element_at(lookup, t), F.array(t)))
    )


def question_tokens(question: Column) -> Column:
    """Distinct question words with synonyms, in order of first appearance."""
    return F.array_distinct(drop_stopwords(expand_synonyms(split_identifier(question))))


def token_overlap(question: Column, name: Column) -> Column:
    """Shared distinct tokens over the root of the name's distinct tokens."""
    names = F.array_distinct(name)
    return F.size(F.array_intersect(question, names)) / F.greatest(F.sqrt(F.size(names)), F.lit(1.0))


def spaced(text: Column) -> Column:
    """Lower-case text with one blank for every run of other characters."""
    return F.regexp_replace(F.lower(text), NOT_WORD, " ")


def padded(word: Column) -> Column:
    """A word between blanks, so that a text search only finds whole words."""
    return F.concat(F.lit(" "), word, F.lit(" "))


def word_bag(words: Column) -> Column:
    """Words as one text that holds each of them between blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def plain_name(identifier: Column) -> Column:
    """Lower-case name with single blanks; null when nothing is left."""
    return let(F.trim(spaced(identifier)), lambda name: choose(name != "", name, F.lit(None).cast("string")))


def compact(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.replace(spaced(text), F.lit(" "), F.lit(""))


def compact_name(plain: Column) -> Column:
    """A plain name without blanks; null when too short to be telling."""
    name = F.replace(plain, F.lit(" "), F.lit(""))
    return choose(F.length(name) >= V.COMPACT_NAME_MIN_LENGTH, name, F.lit(None).cast("string"))


def name_hits(question_lc: Column, question_compact: Column, plain: Column, short: Column) -> Column:
    """Bonus for a name in a question; `question_compact` is the `compact` form and `short` the `compact_name`.

    A question that holds the plain name holds the compact one in its compact
    form, so most names need one search.
    """
    both = F.lit(V.PLAIN_NAME_BONUS + V.COMPACT_NAME_BONUS)
    hit = question_lc.contains(plain)
    told = choose(question_compact.contains(short), choose(hit, both, F.lit(V.COMPACT_NAME_BONUS)), F.lit(0.0))
    return choose(short.isNull(), choose(hit, F.lit(V.PLAIN_NAME_BONUS), F.lit(0.0)), told)


def word_mask(words: Column) -> Column:
    """64 bits that have one set for each word; masks without a common bit have no common word."""
    one = F.lit(1).cast("long")
    bit = lambda w: F.call_function("shiftleft", one, F.hash(w))
    return F.aggregate(words, F.lit(0).cast("long"), lambda mask, w: mask.bitwiseOR(bit(w)))


def substring_score(question: Column, identifier: Column) -> Column:
    """Bonus for a name that occurs literally in the question."""
    plain = plain_name(identifier)
    return name_hits(F.lower(question), compact(question), plain, compact_name(plain))


def asks_for(tokens: Column, hint: tuple) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, hint[1])))


def offers(name_lc: Column, hint: tuple) -> Column:
    return contains_any(name_lc, hint[2])


def bonus(condition: Column, value: float) -> Column:
    return choose(condition, F.lit(value), F.lit(0.0))


def operator_hints(tokens: Column, column_name: Column) -> Column:
    """Date, count and average bonuses; both sides have to show the hint."""
    name = F.lower(column_name)
    date, count, average = (
        bonus(asks_for(tokens, hint) & offers(name, hint), hint[0])
        for hint in (V.DATE_HINT, V.COUNT_HINT, V.AVERAGE_HINT)
    )
    return date + count + average


def key_bonus(is_pk: Column, is_fk: Column) -> Column:
    return bonus(is_pk | is_fk, V.KEY_BONUS)


def sql_contains(sql: Column, fragments: tuple[str, ...]) -> Column:
    return contains_any(F.lower(sql), fragments)


def join_count(sql: Column) -> Column:
    return F.regexp_count(F.lower(sql), F.lit(r"\bjoin\b"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
