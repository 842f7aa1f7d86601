"""Column predicates over answers, sources and grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from askloom.functions.text import _col, once, sentences, strip, words

# A lower-cased answer holding one of these is a non-answer.
NON_ANSWER_PHRASES = (
    "no information",
    "no context",
    "don't know",
    "no clear answer",
    "sorry",
    "no answer",
    "no mention",
    "reminder",
    "context does not provide",
    "no helpful answer",
    "no helpful",
    "no relevant",
    "no question",
    "not clear",
    "don't have enough information",
    " does not have the relevant information",
    "does not seem to be directly related",
)
UNKNOWN_SOURCE = "unknown source"
DONT_KNOW = "I don't know"
CORRECT, INCORRECT = "CORRECT", "INCORRECT"


def is_good_answer(answer: Column | str, phrases: tuple[str, ...] = NON_ANSWER_PHRASES) -> Column:
    """True unless the answer is null or contains a non-answer phrase; never null.

    The answer is computed and lower-cased once, not once per phrase.
    """

    def clean(lowered: Column) -> Column:
        return ~reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in phrases])

    return F.coalesce(once(F.lower(_col(answer)), clean), F.lit(False))


def answer_present(answer: Column | str) -> Column:
    return _col(answer).isNotNull()


def source_of(metadata: Column | str, key: str = "source") -> Column:
    """The metadata's source if the key is there (even when null), else ``unknown source``."""
    m = _col(metadata)
    known = F.coalesce(F.map_contains_key(m, key), F.lit(False))
    return F.when(known, F.element_at(m, key)).otherwise(F.lit(UNKNOWN_SOURCE))


def same_as_answer(grade: Column | str) -> Column:
    """True when the stripped grade reads exactly ``CORRECT``; a null grade is False."""
    return F.coalesce(strip(grade) == CORRECT, F.lit(False))


def find_correct_source(predicted: Column | str, correct: Column | str) -> Column:
    """Equality that is never null; two missing sources are no hit."""
    return F.coalesce(_col(predicted) == _col(correct), F.lit(False))


def overlap_answer(context: Column | str, question: Column | str, least: int = 2) -> Column:
    """Built-in stand-in for a model: the context sentence sharing most distinct words with the question.

    Ties go to the earlier sentence; with fewer than ``least`` shared words the
    answer is ``I don't know``. Null if either side is null.
    """

    def best_sentence(asked: Column) -> Column:
        scored = F.transform(
            sentences(context),
            lambda s, i: F.struct(
                F.size(F.array_intersect(words(s), asked)).alias("shared"),
                (-i).alias("place"),
                s.alias("sentence"),
            ),
        )
        return F.array_max(scored)

    said = once(
        F.array_distinct(words(question)),
        lambda asked: once(
            best_sentence(asked),
            lambda best: F.when(best["shared"] >= least, best["sentence"]).otherwise(
                F.lit(DONT_KNOW)
            ),
        ),
    )
    return F.when(_col(context).isNotNull() & _col(question).isNotNull(), said)


def folded(text: Column | str) -> Column:
    """Lower case, punctuation and spacing folded away, for lenient comparison."""
    return F.array_join(words(text), " ")


def exact_grader(question: Column, answer: Column, prediction: Column) -> Column:
    """Built-in stand-in for a grading model: equal after folding is ``CORRECT``."""
    equal = F.coalesce(folded(answer) == folded(prediction), F.lit(False))
    return F.when(equal, F.lit(CORRECT)).otherwise(F.lit(INCORRECT))
