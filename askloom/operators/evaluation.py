"""Grade predictions against an evaluation set."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.answers import exact_grader, find_correct_source, same_as_answer
from askloom.functions.retry import no_rate_limit
from askloom.operators.answering import Model, ask_in_batches, batch_predict

# A grader maps (question, answer, prediction) columns to a grade text, or to struct<grade, error>.
Grader = Callable[[Column, Column, Column], Column]

GRADED = T.StructType([T.StructField("grade", T.StringType()), T.StructField("error", T.StringType())])
GRADING_TASK = (
    "You compare an answer with the known right one. Reply with the single word CORRECT if both say the "
    "same about the question, else with the single word INCORRECT."
)


def model_grader(
    model: Model,
    is_rate_limit: Callable[[Exception], bool] = no_rate_limit,
    timeout_sec: float = 60,
    wait_sec: float = 2,
    batch_rows: int = 16,
    task: str = GRADING_TASK,
) -> Grader:
    """Wrap a chat model as a grader; every row is sent once, in small batches.

    Rows whose batch ran out of time have a null grade and an error.
    """

    def grade(question: pd.Series, answer: pd.Series, prediction: pd.Series) -> pd.DataFrame:
        chats = [
            [
                {"role": "system", "content": task},
                {"role": "human", "content": f"Question: {q}\nRight answer: {a}\nAnswer to judge: {p}"},
            ]
            for q, a, p in zip(question, answer, prediction)
        ]
        grades, errors = ask_in_batches(model, chats, is_rate_limit, timeout_sec, wait_sec, batch_rows)
        columns = {"grade": grades, "error": errors}
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in columns.items()})

    grade.__annotations__ = dict.fromkeys(("question", "answer", "prediction"), pd.Series) | {"return": pd.DataFrame}
    return F.pandas_udf(grade, GRADED).asNondeterministic()


def grade_answers(df: DataFrame, grader: Grader = exact_grader) -> DataFrame:
    """Add ``grade`` to rows with ``question``, ``answer`` and ``prediction``.

    A grader that also tells errors adds ``grade_error``; it runs once per row.
    """
    made = df.withColumn("_grade", grader(F.col("question"), F.col("answer"), F.col("prediction")))
    if isinstance(made.schema["_grade"].dataType, T.StructType):
        both = F.col("_grade.grade").alias("grade"), F.col("_grade.error").alias("grade_error")
        return made.select(*df.columns, *both)
    return made.withColumnRenamed("_grade", "grade")


def join_eval(
    eval_set: DataFrame, predictions: DataFrame, grades: DataFrame, key: str = "eval_id"
) -> DataFrame:
    """Evaluation rows, predictions and grades brought together by key.

    Inner joins: a row missing on one side is left out, as a zip stops at the shortest.
    """
    return (
        eval_set.select(key, "question", "answer", "correct_source")
        .join(predictions.select(key, F.col("answer").alias("prediction"), "source"), key)
        .join(grades.select(key, "grade"), key)
    )


def to_results(joined: DataFrame, key: str = "eval_id") -> DataFrame:
    """The graded result records with both flags."""
    return joined.select(
        key,
        "question",
        "prediction",
        "source",
        "correct_source",
        "answer",
        find_correct_source("source", "correct_source").alias("find_correct_source"),
        same_as_answer("grade").alias("same_as_answer"),
    )


def accuracy(results: DataFrame) -> DataFrame:
    """Share of answers graded correct; null for an empty set."""
    return results.agg(F.avg(F.col("same_as_answer").cast("int")).alias("accuracy"))


def source_rate(results: DataFrame) -> DataFrame:
    """Share of answers taken from the correct source; null for an empty set."""
    return results.agg(F.avg(F.col("find_correct_source").cast("int")).alias("source_rate"))


def evaluate(
    eval_set: DataFrame,
    index: DataFrame,
    embedder,
    k: int = 5,
    grader: Grader = exact_grader,
    **predict_options,
) -> DataFrame:
    """Predict, grade and flag a whole evaluation set in one plan.

    Predictions keep their evaluation row, so no join back is needed.
    """
    questions = eval_set.withColumnRenamed("eval_id", "question_id").withColumnRenamed(
        "answer", "_answer"
    )
    predicted = batch_predict(questions, index, embedder, k, **predict_options).select(
        F.col("question_id").alias("eval_id"),
        "question",
        "correct_source",
        F.col("_answer").alias("answer"),
        F.col("answer").alias("prediction"),
        "source",
    )
    return to_results(grade_answers(predicted, grader))


def evaluate_summary(results: DataFrame) -> DataFrame:
    """One row: size of the set, accuracy and source rate."""
    return results.agg(
        F.count("*").alias("n_rows"),
        F.avg(F.col("same_as_answer").cast("int")).alias("accuracy"),
        F.avg(F.col("find_correct_source").cast("int")).alias("source_rate"),
    )
