import pytest
from pyspark.sql import functions as F

from askloom.functions.answers import (
    NON_ANSWER_PHRASES,
    find_correct_source,
    is_good_answer,
    overlap_answer,
    same_as_answer,
    source_of,
)
from askloom.functions.text import (
    EMPTY_QUESTION_ERROR,
    build_prompt,
    expand_abbreviations,
    json_path,
    script_statements,
    strip,
    validate_question,
)
from askloom.functions.vectors import hashed_embedding
from askloom.operators.answering import (
    answer_cascade,
    answer_until_good,
    batch_predict,
    call_with_retry,
    generate_answers,
    model_generator,
)
from askloom.operators.embedding import build_index
from askloom.operators.evaluation import (
    accuracy,
    evaluate,
    evaluate_summary,
    grade_answers,
    join_eval,
    source_rate,
    to_results,
)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def applied(df, expression):
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_every_phrase_is_a_non_answer(spark):
    said = [f"Well, {p.upper()} here" for p in NON_ANSWER_PHRASES]
    assert applied(column(spark, said), is_good_answer("c")) == [False] * len(said)


def test_good_answers(spark):
    said = [None, "", "fine", "does not have the relevant information", "unsorryful", "Clear."]
    assert applied(column(spark, said), is_good_answer("c")) == [False, True, True, True, False, True]


def test_source_of_metadata(spark):
    maps = [{"source": "u"}, {"lang": "en"}, {"source": None}, None]
    df = column(spark, maps, "map<string,string>")
    assert applied(df, source_of("c")) == ["u", "unknown source", None, "unknown source"]


def test_grades_and_sources(spark):
    grades = ["CORRECT", "\n CORRECT\t", "correct", "INCORRECT", None]
    assert applied(column(spark, grades), same_as_answer("c")) == [True, True, False, False, False]
    df = spark.createDataFrame(
        [(0, "a", "a"), (1, "a", "b"), (2, None, "a"), (3, None, None)], "i int, p string, t string"
    )
    assert applied(df, find_correct_source("p", "t")) == [True, False, False, False]


def test_blank_questions(spark):
    asked = ["hi", "", " \n\t", " ", None]
    assert applied(column(spark, asked), validate_question("c")) == [None] + [EMPTY_QUESTION_ERROR] * 4
    assert applied(column(spark, ["\n a b \r\n"]), strip("c")) == ["a b"]


def test_prompt_leaves_data_alone(spark):
    context = r"cost $1 {question} \d {context}"
    df = spark.createDataFrame([(context, "why $0?")], "c string, q string")
    chat = df.select(build_prompt("c", "q", system="sys")).first()[0]
    assert [m.role for m in chat] == ["system", "human"]
    assert chat[0].content == "sys"
    assert chat[1].content == f"Given the context: {context}. Answer the question why $0?."


def test_abbreviations(spark):
    asked = ["ml and HTML", "Udf?", "no", None, "MLs ML."]
    want = [
        "ML (Machine Learning) and HTML",
        "UDF (User Defined Function)?",
        "no",
        None,
        "MLs ML (Machine Learning).",
    ]
    pairs = {"ML": "Machine Learning", "UDF": "User Defined Function"}
    assert applied(column(spark, asked), expand_abbreviations("c", pairs)) == want
    odd = expand_abbreviations("c", {"C": "$1\\x"})
    assert applied(column(spark, ["a c"]), odd) == ["a C ($1\\x)"]


def test_json_paths(spark):
    records = ['{"tags": {"kind": "ReTry"}}', '{"tags": {}}', "{}", "not json", None]
    got = applied(column(spark, records), json_path("c", "tags?.kind?"))
    assert got == ["retry", None, None, None, None]


def test_scripts(spark):
    script = "-- a; b\nselect 1;\n\n ;\n  -- only\n;select ';'"
    got = applied(column(spark, [script, "", None]), script_statements("c"))
    assert [s.strip() for s in got[0]] == ["b\nselect 1;", "select ';", "';"]
    assert got[1:] == [[], None]


def test_overlap_answer(spark):
    df = spark.createDataFrame(
        [
            (0, "The moon. The tide follows the moon! Ships sail.", "Does the tide follow a moon"),
            (1, "Nothing here. At all.", "Does the tide follow"),
            (2, None, "x"),
            (3, "", "x y"),
        ],
        "i int, c string, q string",
    )
    got = applied(df, overlap_answer("c", "q"))
    assert got == ["The tide follows the moon", "I don't know", None, "I don't know"]


def candidates(spark):
    questions = spark.createDataFrame(
        [(1, "tide moon sun"), (2, "tide moon"), (3, "nothing alike"), (4, "unseen words")],
        "question_id long, question string",
    )
    near = spark.createDataFrame(
        [
            (1, 2, "tide and moon later.", {"source": "b"}),
            (1, 1, "sorry tide moon. x", {"source": "a"}),
            (1, 3, "tide moon sun.", {"source": "c"}),
            (2, 1, "the moon, the tide.", {"lang": "en"}),
            (3, 1, "far away.", {"source": "d"}),
        ],
        "question_id long, rank int, text string, metadata map<string,string>",
    )
    return questions, near


def test_cascade_takes_the_first_good_answer(spark):
    got = answer_cascade(*candidates(spark)).orderBy("question_id").collect()
    assert [(r.question_id, r.answer, r.source) for r in got] == [
        (1, "tide and moon later", "b"),
        (2, "the moon, the tide", "unknown source"),
        (3, None, None),
        (4, None, None),
    ]
    assert got[0].output_metadata == {"model": "word-overlap"} and got[2].output_metadata is None


def echo_or_sorry(chats):
    return ["Sorry" if "sorry" in c[-1]["content"] else c[-1]["content"][:30] for c in chats]


def test_early_stop_equals_the_full_cascade(spark):
    questions, near = candidates(spark)
    calls = spark.sparkContext.accumulator(0)

    def model(chats):
        calls.add(len(chats))
        return echo_or_sorry(chats)

    fields = ("question_id", "question", "answer", "source", "output_metadata")
    early = answer_until_good(questions, near, model, "echo").select(*fields).collect()
    assert calls.value == 4  # of five candidates
    full = answer_cascade(questions, near, model_generator(echo_or_sorry, "echo"))
    assert sorted(map(str, early)) == sorted(map(str, full.select(*fields).collect()))


class Busy(Exception):
    pass


def test_retry_waits_then_gives_up():
    now, tries = [0.0], []

    def sleep(seconds):
        now[0] += seconds

    def call():
        tries.append(now[0])
        if len(tries) < 3:
            raise Busy("slow down")
        return ["ok"]

    options = {"is_rate_limit": lambda e: isinstance(e, Busy), "clock": lambda: now[0], "sleep": sleep}
    assert call_with_retry(call, **options) == (["ok"], None)
    assert tries == [0, 2, 4]
    tries.clear()
    result, error = call_with_retry(call, timeout_sec=3, **options)
    assert result is None and "slow down" in error
    with pytest.raises(ZeroDivisionError):
        call_with_retry(lambda: 1 / 0, **options)


def test_model_errors_become_a_column(spark):
    def limited(chats):
        raise RuntimeError("429")

    df = spark.createDataFrame([("c", "q")], "text string, question string")
    busy = model_generator(
        limited, is_rate_limit=lambda e: "429" in str(e), timeout_sec=0.05, wait_sec=0.01
    )
    row = generate_answers(df, busy).first()
    assert row.answer is None and "429" in row.error
    with pytest.raises(Exception, match="429"):
        generate_answers(df, model_generator(limited)).collect()


def index_of(spark, texts):
    docs = spark.createDataFrame(
        [(i, t, f"src{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string"
    )
    built = build_index(docs, size=20, overlap=2, embedder=hashed_embedding(32))
    return built.select(
        "chunk_id", "text", F.create_map(F.lit("source"), "source").alias("metadata"), "embedding"
    )


def test_batch_predict_and_evaluate(spark):
    index = index_of(spark, ["The tide follows the moon. Ships wait.", "Bread needs salt and time."])
    evals = spark.createDataFrame(
        [
            (1, "what does the tide follow", "the tide, follows the MOON", "src0"),
            (2, "does bread need salt", "It needs yeast", "src1"),
            (3, " \n", "x", None),
            (4, "zebra quagga", "y", None),
        ],
        "eval_id long, question string, answer string, correct_source string",
    )
    embedder = hashed_embedding(32)
    questions = evals.select(F.col("eval_id").alias("question_id"), "question")
    got = {r.question_id: r for r in batch_predict(questions, index, embedder, 2).collect()}
    assert got[1].answer == "The tide follows the moon" and got[1].source == "src0"
    assert got[3].answer == EMPTY_QUESTION_ERROR and got[3].source is None
    assert got[4].answer is None
    results = evaluate(evals, index, embedder, 2)
    flags = {r.eval_id: (r.find_correct_source, r.same_as_answer) for r in results.collect()}
    assert flags == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False)}
    summary = evaluate_summary(results).first()
    assert (summary.n_rows, summary.accuracy, summary.source_rate) == (4, 0.25, 0.5)


def test_eval_join_stops_at_the_shortest(spark):
    evals = spark.createDataFrame(
        [(i, "q", "a", "s") for i in range(4)], "eval_id int, question string, answer string, correct_source string"
    )
    predictions = spark.createDataFrame([(i, "p", "s") for i in range(3)], "eval_id int, answer string, source string")
    grades = spark.createDataFrame([(1, "CORRECT"), (2, None), (9, "CORRECT")], "eval_id int, grade string")
    results = to_results(join_eval(evals, predictions, grades))
    assert sorted(tuple(r) for r in results.collect()) == [
        (1, "q", "p", "s", "s", "a", True, True),
        (2, "q", "p", "s", "s", "a", True, False),
    ]
    assert accuracy(results).first().accuracy == 0.5
    assert source_rate(results).first().source_rate == 1.0
    none = results.filter("eval_id > 90")
    assert accuracy(none).first().accuracy is None and source_rate(none).first().source_rate is None


def test_default_grader(spark):
    df = spark.createDataFrame(
        [("q", "A b.", "a  B"), ("q", "a", "b"), ("q", "a", None)], "question string, answer string, prediction string"
    )
    assert [r.grade for r in grade_answers(df).collect()] == ["CORRECT", "INCORRECT", "INCORRECT"]
