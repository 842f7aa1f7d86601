"""From retrieved chunks to one answer per question."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloom.functions.answers import NON_ANSWER_PHRASES, is_good_answer, overlap_answer, source_of
from askloom.functions.retry import call_with_retry, no_rate_limit
from askloom.functions.text import build_prompt, expand_abbreviations, validate_question
from askloom.operators.retrieval import retrieve

# A generator maps (context, question) columns to struct<answer, error, output_metadata>.
Generator = Callable[[Column, Column], Column]
# A model maps a batch of chats, each a list of {"role", "content"}, to as many texts.
Model = Callable[[Sequence[list[dict]]], Sequence[str | None]]

GENERATED = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("output_metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def overlap_generator(context: Column, question: Column) -> Column:
    """Built-in stand-in for a model, all native columns."""
    return F.struct(
        overlap_answer(context, question).alias("answer"),
        F.lit(None).cast("string").alias("error"),
        F.create_map(F.lit("model"), F.lit("word-overlap")).alias("output_metadata"),
    )


def _prompt_batch(prompts: Iterable) -> list[list[dict]]:
    return [[{"role": m["role"], "content": m["content"]} for m in chat] for chat in prompts]


def ask_in_batches(
    model: Model,
    chats: Sequence[list[dict]],
    is_rate_limit: Callable[[Exception], bool],
    timeout_sec: float,
    wait_sec: float,
    batch_rows: int,
) -> tuple[list[str | None], list[str | None]]:
    """The model's text and error for each chat. A batch that runs out of time has errors only."""
    answers: list[str | None] = []
    errors: list[str | None] = []
    for start in range(0, len(chats), batch_rows):
        batch = chats[start : start + batch_rows]
        got, error = call_with_retry(lambda batch=batch: model(batch), is_rate_limit, timeout_sec, wait_sec)
        if got is not None and len(got) != len(batch):
            raise ValueError("the model must return one text per chat")
        answers += [None] * len(batch) if got is None else list(got)
        errors += [error] * len(batch)
    return answers, errors


def model_generator(
    model: Model,
    name: str = "model",
    is_rate_limit: Callable[[Exception], bool] = no_rate_limit,
    timeout_sec: float = 60,
    wait_sec: float = 2,
    batch_rows: int = 16,
    **prompt_options: str,
) -> Generator:
    """Wrap a chat model as a generator; every row is sent once, in small batches."""

    def generate(prompts: pd.Series) -> pd.DataFrame:
        answers, errors = ask_in_batches(
            model, _prompt_batch(prompts), is_rate_limit, timeout_sec, wait_sec, batch_rows
        )
        return pd.DataFrame(
            {
                "answer": pd.Series(answers, dtype=object),
                "error": pd.Series(errors, dtype=object),
                "output_metadata": [{"model": name}] * len(prompts),
            }
        )

    generate.__annotations__ = {"prompts": pd.Series, "return": pd.DataFrame}
    call = F.pandas_udf(generate, GENERATED).asNondeterministic()
    return lambda context, question: call(build_prompt(context, question, **prompt_options))


def generate_answers(
    candidates: DataFrame,
    generator: Generator = overlap_generator,
    context: str = "text",
    question: str = "question",
) -> DataFrame:
    """Add ``answer``, ``error`` and ``output_metadata`` to every (question, context) row."""
    made = candidates.withColumn("_made", generator(F.col(context), F.col(question)))
    return made.select(
        *candidates.columns,
        F.col("_made.answer").alias("answer"),
        F.col("_made.error").alias("error"),
        F.col("_made.output_metadata").alias("output_metadata"),
    )


def keep_unanswered(
    questions: DataFrame, best: DataFrame, key: str = "question_id"
) -> DataFrame:
    """One row per question; those without an answer keep nulls."""
    return questions.join(best, key, "left")


def first_good_answer(
    scored: DataFrame,
    key: str = "question_id",
    rank: str = "rank",
    fields: Sequence[str] = ("answer", "source", "output_metadata"),
    error: str | None = None,
) -> DataFrame:
    """The good answer of smallest rank per question; questions without one give no row.

    Aggregated, so each task sends on at most one row per question. Bad answers
    lose their rank, which ``min_by`` skips: a filter would be pushed into the
    generator's expression and repeat it for every phrase.

    With an ``error`` column, an error before the first good answer ends the walk:
    the question keeps the error and null fields, because a worse-ranked answer
    might not be the one that a working model would have given.
    """
    good, wanted = is_good_answer("answer"), [F.col(f) for f in fields]
    if error is not None:
        failed = F.col(error).isNotNull()
        good = good | failed
        wanted = [F.when(~failed, c).alias(f) for c, f in zip(wanted, fields)] + [F.col(error)]
        fields = (*fields, error)
    best = scored.groupBy(key).agg(F.min_by(F.struct(*wanted), F.when(good, F.col(rank))).alias("_best"))
    found = best.filter(F.col("_best").isNotNull())
    return found.select(key, *[F.col(f"_best.{f}").alias(f) for f in fields])


def best_answers(
    questions: DataFrame,
    candidates: DataFrame,
    generator: Generator = overlap_generator,
    key: str = "question_id",
) -> DataFrame:
    """Generate an answer from every candidate and keep each question's first good one, or its error."""
    asked = candidates.join(questions.select(key, "question"), key)
    scored = generate_answers(asked, generator).withColumn("source", source_of("metadata"))
    return first_good_answer(scored, key, error="error")


def answer_cascade(
    questions: DataFrame,
    candidates: DataFrame,
    generator: Generator = overlap_generator,
    key: str = "question_id",
) -> DataFrame:
    """Walk each question's candidates nearest first; the first good answer wins.

    A model call that failed before it leaves the question unanswered, with the ``error``.

    ``candidates`` holds ``key, rank, text, metadata``. Scores every candidate,
    which is right for cheap generators; see ``answer_until_good`` for paid models.
    """
    return keep_unanswered(questions, best_answers(questions, candidates, generator, key), key)


def answer_until_good(
    questions: DataFrame,
    candidates: DataFrame,
    model: Model,
    name: str = "model",
    is_rate_limit: Callable[[Exception], bool] = no_rate_limit,
    timeout_sec: float = 60,
    wait_sec: float = 2,
    key: str = "question_id",
    batch_rows: int = 16,
    **prompt_options: str,
) -> DataFrame:
    """The same result with early stop: no model call after a question's first good answer or error.

    Each question becomes one row with its (at most k) candidates in rank order.
    Wave r asks, in batches of ``batch_rows``, about the r-th candidate of the questions still open.
    """
    chat = build_prompt("text", "question", **prompt_options)
    rows = (
        candidates.join(questions.select(key, "question"), key)
        .withColumn("source", source_of("metadata"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("rank", chat.alias("chat"), "source"))).alias("tries"))
    )
    out = T.StructType(
        [
            questions.schema[key],
            T.StructField("answer", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("output_metadata", T.MapType(T.StringType(), T.StringType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def walk(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            tries = [list(t) for t in batch["tries"]]
            found: dict[int, tuple] = {}
            for wave in range(max((len(t) for t in tries), default=0)):
                waiting = [i for i, t in enumerate(tries) if i not in found and wave < len(t)]
                if not waiting:
                    break
                chats = _prompt_batch(tries[i][wave]["chat"] for i in waiting)
                made = ask_in_batches(model, chats, is_rate_limit, timeout_sec, wait_sec, batch_rows)
                for i, answer, error in zip(waiting, *made):
                    lowered = None if answer is None else answer.lower()
                    if error is not None:
                        found[i] = (None, None, None, error)
                    elif lowered is not None and not any(p in lowered for p in NON_ANSWER_PHRASES):
                        found[i] = (answer, tries[i][wave]["source"], {"model": name}, None)
            hits = sorted(found)
            yield pd.DataFrame(
                {
                    key: batch[key].iloc[hits].to_numpy(),
                    "answer": [found[i][0] for i in hits],
                    "source": [found[i][1] for i in hits],
                    "output_metadata": [found[i][2] for i in hits],
                    "error": pd.Series([found[i][3] for i in hits], dtype=object),
                }
            )

    return keep_unanswered(questions, rows.mapInPandas(walk, out), key)


def batch_predict(
    questions: DataFrame,
    index: DataFrame,
    embedder,
    k: int = 5,
    generator: Generator = overlap_generator,
    abbreviations: dict[str, str] | None = None,
    **search_options,
) -> DataFrame:
    """Questions in, one answer record each: retrieve, generate, keep the first good answer.

    A blank question is not searched for; its answer is the error text. ``error``
    tells a failed model call from a question without a good answer.
    ``index`` needs ``chunk_id, text, metadata, embedding``.
    """
    error = validate_question("question")
    usable = questions.filter(error.isNull())
    asked = usable
    if abbreviations:
        asked = usable.withColumn("question", expand_abbreviations("question", abbreviations))
    near = retrieve(
        asked.select("question_id", "question"),
        index,
        embedder,
        k,
        payload=("text", "metadata"),
        **search_options,
    )
    best = best_answers(asked, near, generator)
    answered = keep_unanswered(questions, best)
    return answered.withColumn("answer", F.coalesce(validate_question("question"), F.col("answer")))
