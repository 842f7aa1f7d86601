"""String columns: tokens, words, sentences, prompts, abbreviations, SQL scripts, JSON paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WHITESPACE = r"[ \t\n\x0B\f\r]+"
NON_WORD = r"[^\p{L}\p{N}]+"
SENTENCE = r"[^.!?\n]+"
EMPTY_QUESTION_ERROR = "ERROR the question should not be empty"
HUMAN_TEMPLATE = "Given the context: {context}. Answer the question {question}."

# Defaults of this library; pass others as needed.
SYSTEM_MESSAGE = (
    "Answer the question from the given context only. If the context is irrelevant, "
    "not enough, or the question is incomplete, just say I don't know."
)
ABBREVIATIONS = {"RPM": "revolutions per minute", "MPH": "miles per hour"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time.

    Spark does not share common expressions that hold lambdas; a one-element
    array binds the value to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Whitespace-separated tokens; null stays null, blank text has none."""
    return F.array_remove(F.split(_col(text), WHITESPACE), "")


def spaced_tokens(text: Column | str) -> Column:
    """Tokens that keep the whitespace in front of them, so joining by '' restores the text."""
    return F.regexp_extract_all(_col(text), F.lit(r"\s*\S+"), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(_col(text)), NON_WORD), "")


def sentences(text: Column | str) -> Column:
    """Pieces between sentence marks or line ends, trimmed, blank ones left out."""
    pieces = F.regexp_extract_all(_col(text), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def text_length(text: Column | str) -> Column:
    """Length in characters."""
    return F.length(_col(text))


def strip(text: Column | str) -> Column:
    """Drop all leading and trailing whitespace, line ends included (plain ``trim`` keeps those)."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    return strip(text) == ""


def validate_question(question: Column | str) -> Column:
    """The error text for a blank question, null for a usable one."""
    return F.when(F.coalesce(is_blank(question), F.lit(True)), F.lit(EMPTY_QUESTION_ERROR))


def build_prompt(
    context: Column | str,
    question: Column | str,
    system: str = SYSTEM_MESSAGE,
    template: str = HUMAN_TEMPLATE,
) -> Column:
    """Chat messages ``array<struct<role, content>>``.

    The template is cut at its placeholders on the driver and rejoined with
    ``concat``, so ``$1``, backslashes or braces in the data stay as they are.
    """
    slots = {"{context}": _col(context), "{question}": _col(question)}
    parts = [p for p in re.split(r"(\{context\}|\{question\})", template) if p]
    human = F.concat(*[slots[p] if p in slots else F.lit(p) for p in parts])
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("human").alias("role"), human.alias("content")),
    )


def expand_abbreviations(text: Column | str, pairs: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """Whole-word, case-insensitive ``ABBR`` becomes ``ABBR (Full text)``, pair after pair."""
    out = _col(text)
    for short, full in pairs.items():
        replacement = f"{short} ({full})".replace("\\", "\\\\").replace("$", "\\$")
        out = F.regexp_replace(out, rf"(?iuU)\b{re.escape(short)}\b", replacement)
    return out


def json_path(record: Column | str, path: str) -> Column:
    """Lower-cased value under a dotted path such as ``tags?.kind?``; missing parts give null.

    Spark's JSON lookup answers null for any missing step, so the ``?`` marks
    carry no extra meaning here.
    """
    steps = [s.rstrip("?") for s in path.split(".")]
    return F.lower(F.get_json_object(_col(record), "$" + "".join(f"['{s}']" for s in steps)))


def script_statements(script: Column | str) -> Column:
    """Statements of a ``;``-separated script, in order, each closed with ``;``.

    Every ``;`` splits, also inside literals and comments. Comment lines are
    blanked (with the blank lines before them), empty pieces are dropped.
    """
    pieces = F.transform(
        F.split(_col(script), ";"),
        lambda p: F.regexp_replace(p, r"(?mdU)^\s*--.*$", ""),
    )
    return F.transform(
        F.filter(pieces, lambda p: ~is_blank(p)), lambda p: F.concat(p, F.lit(";"))
    )
