"""DuckDB SQL with the same rows as the registered queries.

Small Python helpers only paste SQL fragments together; each entry is one statement.
"""

from __future__ import annotations

from askloom.functions.answers import NON_ANSWER_PHRASES, UNKNOWN_SOURCE
from askloom.functions.text import ABBREVIATIONS, EMPTY_QUESTION_ERROR, SYSTEM_MESSAGE
from askloom.plans.fixtures import DIM, K, OVERLAP, SIZE

STEP = SIZE - OVERLAP


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[ \t\n\x0B\f\r]+'), lambda t: t <> '')"


def _words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _chunks(docs: str = "documents", size: int = SIZE, step: int = STEP, cols: str = "doc_id, lang, source") -> str:
    return f"""cut AS (
      SELECT {cols}, {_tokens('text')} AS tk FROM {docs}
    ), starts AS (
      SELECT {cols}, tk, len(range(0, len(tk), {step})) AS num_chunks,
             unnest(range(0, len(tk), {step})) AS s FROM cut
    ), chunks AS (
      SELECT {cols}, num_chunks::INTEGER AS num_chunks, (s // {step})::INTEGER AS chunk_no,
             doc_id::VARCHAR || '-' || (s // {step})::VARCHAR AS chunk_id,
             array_to_string(tk[s + 1:s + {size}], ' ') AS text
      FROM starts
    )"""


def _embedded(name: str, source: str, cols: str, text: str) -> str:
    return f"""{name}_b AS (
      SELECT {cols}, list_transform({_words(text)},
             lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM}) AS b FROM {source}
    ), {name}_c AS (
      SELECT {cols}, list_transform(range(0, {DIM}),
             lambda d: len(list_filter(b, lambda x: x = d))::DOUBLE) AS c FROM {name}_b
    ), {name} AS (
      SELECT {cols}, list_transform(c, lambda x: (x / greatest(
             sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-300))::FLOAT::DOUBLE) AS v FROM {name}_c
    )"""


def _l2sq(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


_INDEX = (
    "asked AS (SELECT item_id AS question_id, text AS question FROM benchmark), "
    + _chunks()
    + ", "
    + _embedded("qv", "asked", "question_id, question", "question")
    + ", "
    + _embedded("iv", "chunks", "chunk_id, doc_id, source, text", "text")
)
_NEAR = (
    _INDEX
    + f""", near AS (
      SELECT question_id, question, chunk_id, doc_id, source, text, {_l2sq('qv.v', 'iv.v')} AS distance,
             row_number() OVER (PARTITION BY question_id
               ORDER BY {_l2sq('qv.v', 'iv.v')}, chunk_id)::INTEGER AS rank
      FROM qv, iv QUALIFY rank <= {K}
    )"""
)
_SENTENCES = r"""list_filter(list_transform(regexp_extract_all({x}, '[^.!?\n]+'), lambda s: trim(s)),
             lambda s: s <> '')"""
_MADE = (
    _NEAR
    + f""", spoken AS (
      SELECT question_id, question, rank, source, unnest({_SENTENCES.format(x='text')}) AS sentence,
             generate_subscripts({_SENTENCES.format(x='text')}, 1) AS place FROM near
    ), shared AS (
      SELECT *, len(list_intersect(list_distinct({_words('sentence')}),
                                   list_distinct({_words('question')}))) AS n FROM spoken
    ), made AS (
      SELECT question_id, question, rank, source,
             CASE WHEN n >= 2 THEN sentence ELSE 'I don''t know' END AS answer
      FROM shared QUALIFY row_number() OVER (PARTITION BY question_id, rank ORDER BY n DESC, place) = 1
    )"""
)
_GOOD = "(answer IS NOT NULL AND NOT (" + " OR ".join(
    f"contains(lower(answer), {_quote(p)})" for p in NON_ANSWER_PHRASES
) + "))"
_ANSWERED = (
    _MADE
    + f""", best AS (
      SELECT * FROM made WHERE {_GOOD}
      QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) = 1
    ), answered AS (
      SELECT a.question_id, a.question, b.answer, b.source,
             CASE WHEN b.answer IS NOT NULL THEN 'word-overlap' END AS model
      FROM asked a LEFT JOIN best b USING (question_id)
    )"""
)
_EVAL_SET = f"""held AS (
      SELECT b.item_id, arg_min(d.source, d.doc_id) AS correct_source
      FROM benchmark b JOIN documents d ON contains(d.text, b.text)
      GROUP BY b.item_id
    ), told AS (
      SELECT item_id, unnest({_SENTENCES.format(x='text')}) AS sentence,
             generate_subscripts({_SENTENCES.format(x='text')}, 1) AS place FROM benchmark
    ), longest AS (
      SELECT item_id, sentence FROM told QUALIFY row_number() OVER (
        PARTITION BY item_id ORDER BY len(list_distinct({_words('sentence')})) DESC, place) = 1
    ), eval_set AS (
      SELECT item_id AS eval_id, text AS question, sentence AS answer, correct_source
      FROM benchmark LEFT JOIN longest USING (item_id) LEFT JOIN held USING (item_id)
    )"""
_GRADED = (
    _EVAL_SET
    + """, joined AS (
      SELECT eval_id, question, answer, correct_source,
             CASE eval_id % 3 WHEN 0 THEN answer WHEN 1 THEN 'something else' END AS prediction,
             CASE WHEN eval_id % 2 = 0 THEN correct_source ELSE 'src0' END AS source,
             CASE eval_id % 3 WHEN 0 THEN 'CORRECT' WHEN 1 THEN chr(10) || 'CORRECT ' ELSE 'INCORRECT' END AS grade
      FROM eval_set
    ), results AS (
      SELECT eval_id, question, prediction, source, correct_source, answer,
             coalesce(source = correct_source, false) AS find_correct_source,
             grade IN ('CORRECT', chr(10) || 'CORRECT ') AS same_as_answer
      FROM joined
    )"""
)
_FOLDED = "array_to_string({words}, ' ')"
_EVALUATED = (
    _ANSWERED
    + ", "
    + _EVAL_SET
    + f""", evaluated AS (
      SELECT e.eval_id, e.question, a.answer AS prediction, a.source, e.correct_source, e.answer,
             coalesce(a.source = e.correct_source, false) AS find_correct_source,
             coalesce({_FOLDED.format(words=_words('e.answer'))}
                      = {_FOLDED.format(words=_words('a.answer'))}, false) AS same_as_answer
      FROM eval_set e JOIN answered a ON a.question_id = e.eval_id
    )"""
)
_MADE_ANSWERS = f"""said AS (
      SELECT *, ((conv_id * 7 + turn * 3) % 40)::INTEGER AS pick FROM conversations
    ), made AS (
      SELECT conv_id AS question_id, turn + 1 AS rank, 'turn-' || turn::VARCHAR AS source,
             CASE WHEN pick < {len(NON_ANSWER_PHRASES)}
                  THEN text || ' ' || upper([{', '.join(_quote(p) for p in NON_ANSWER_PHRASES)}][pick + 1])
                  WHEN pick < 20 THEN NULL ELSE text END AS answer
      FROM said
    )"""
_DOC_STATE = """changes AS (
      SELECT doc_id, 'delete' AS op, 2 AS version, text FROM documents WHERE doc_id % 10 = 0
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 10 > 1 THEN 'update' END, 2, text || ' edit two' FROM documents
        WHERE doc_id % 10 IN (1, 2, 3)
      UNION ALL SELECT doc_id, 'update', 3, text || ' edit three' FROM documents WHERE doc_id % 10 = 2
      UNION ALL SELECT doc_id, 'delete', 3, text FROM documents WHERE doc_id % 10 = 3
      UNION ALL SELECT doc_id, 'update', 0, text || ' stale' FROM documents WHERE doc_id % 10 = 4
      UNION ALL SELECT -doc_id, 'insert', 1, text || ' new' FROM documents WHERE doc_id % 10 = 5
      UNION ALL SELECT doc_id, 'insert', 1, text FROM documents
    ), state AS (
      SELECT doc_id, version::BIGINT AS version, text FROM (
        SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1
      ) WHERE op IS DISTINCT FROM 'delete'
    )"""


_SNAPSHOTS = """newer AS (
      SELECT doc_id, CASE WHEN doc_id % 97 = 1 THEN text || ' edited' ELSE text END AS text,
             CASE WHEN doc_id % 97 = 2 THEN 'elsewhere' ELSE source END AS source
      FROM documents WHERE doc_id % 97 <> 0
      UNION ALL SELECT -doc_id, text, source FROM documents WHERE doc_id % 97 = 3
    )"""


_STREAMED_ANSWERS = (
    _DOC_STATE
    + ", "
    + _ANSWERED.replace(_chunks(), _chunks("state", cols=f"doc_id, version, {_quote(UNKNOWN_SOURCE)} AS source"))
)


def _self_search(distance: str, where: str = "true") -> str:
    return f"""hits AS (
      SELECT q.vec_id AS question_id, i.vec_id, i.label, {distance} AS distance,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, i.vec_id)::INTEGER AS rank
      FROM vecs q JOIN vecs i ON q.vec_id <> i.vec_id AND {where} QUALIFY rank <= {K}
    )"""


_VECS = "vecs AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_COSINE_SELF = (
    f"1 - {_dot('q.v', 'i.v')} / (sqrt({_dot('q.v', 'q.v')}) * sqrt({_dot('i.v', 'i.v')}))"
)


def _hits(distance: str, where: str = "true") -> str:
    return f"WITH {_VECS}, {_self_search(distance, where)} "


_FLAT_HITS = "SELECT question_id, rank, vec_id, label, round(distance, 6) AS distance FROM hits"


def _abbreviated(x: str) -> str:
    out = x
    for short, full in ABBREVIATIONS.items():
        out = f"regexp_replace({out}, '(?i)\\b{short}\\b', '{short} ({full})', 'g')"
    return out


def oracles() -> dict[str, str]:
    chunk_rows = f"WITH {_chunks()} "
    l2_self = _l2sq("q.v", "i.v")
    sql = {
        "json_document_scan": "SELECT doc_id, text, source, NULL::VARCHAR AS _corrupt_record FROM documents",
        "save_sources_table": "SELECT doc_id, source, n_chars FROM documents",
        "scan_sources": "SELECT doc_id, text, source FROM documents",
        "project_all_columns": "SELECT * FROM documents",
        "eval_set_scan": f"WITH {_EVAL_SET} SELECT * FROM eval_set",
        "results_to_table": f"WITH {_GRADED} SELECT * FROM results",
        "index_write_read": """SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding,
            lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings""",
        "index_describe": """SELECT count(*) AS n_rows, min(len(embedding)) AS min_dim,
            max(len(embedding)) AS max_dim,
            sum(CASE WHEN embedding IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_missing FROM embeddings""",
        "select_source_fields": "SELECT text, source FROM documents",
        "chunk_reshape": chunk_rows
        + """SELECT doc_id, lang, source, num_chunks, chunk_no, chunk_id,
            length(text)::INTEGER AS chars FROM chunks""",
        "split_text_and_metadata": chunk_rows
        + """SELECT text AS page_content, unnest(['doc_id', 'lang', 'source', 'chunk_no', 'chunk_id']) AS meta_key,
            unnest([doc_id::VARCHAR, lang, source, chunk_no::VARCHAR, chunk_id]) AS meta_value FROM chunks""",
        "results_to_documents": f"""WITH {_NEAR} SELECT question_id, rank, text AS page_content, chunk_id,
            source, 2::INTEGER AS n_metadata, round(distance, 6) AS score FROM near""",
        "response_documents": f"""WITH {_NEAR} SELECT question_id, rank, chunk_id AS page_content,
            source, 1::INTEGER AS n_metadata, round(distance, 6) AS score FROM near""",
        "content_only_documents": f"WITH {_NEAR} SELECT question_id, rank, text AS page_content FROM near",
        "source_or_unknown": f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source
            WHEN 1 THEN {_quote(UNKNOWN_SOURCE)} END AS source_label FROM documents""",
        "answer_present": f"""WITH {_MADE_ANSWERS} SELECT question_id, answer FROM made
            WHERE rank = 1 AND answer IS NOT NULL""",
        "good_answer_filter": f"WITH {_MADE_ANSWERS} SELECT question_id, rank, answer FROM made WHERE {_GOOD}",
        "reject_empty_question": f"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0
            OR {_strip('text')} = '' THEN {_quote(EMPTY_QUESTION_ERROR)} END AS error FROM conversations""",
        "filtered_retrieval": _hits(l2_self, "i.label = 5") + _FLAT_HITS,
        "eval_join": f"""WITH {_GRADED} SELECT eval_id, question, answer, correct_source, prediction,
            source, grade FROM joined""",
        "knn_join": _hits(l2_self) + _FLAT_HITS,
        "knn_join_matched": _hits(
            l2_self,
            """(q.vec_id % 25 = 0 OR q.label * 3 % 10 = CASE WHEN i.label < 4 THEN 0 ELSE i.label END)""",
        )
        + _FLAT_HITS,
        "knn_join_cosine": _hits(_COSINE_SELF) + _FLAT_HITS,
        "knn_join_inner_product": _hits(f"-{_dot('q.v', 'i.v')}") + _FLAT_HITS,
        "keep_unanswered": f"""WITH {_MADE_ANSWERS}, best AS (
              SELECT * FROM made WHERE {_GOOD}
              QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) = 1)
            SELECT q.question_id, b.answer, b.source
            FROM (SELECT DISTINCT question_id FROM made) q LEFT JOIN best b USING (question_id)""",
        "count_sources": "SELECT count(*) AS n_rows FROM documents",
        "count_chunks": chunk_rows + "SELECT count(*) AS n_rows FROM chunks",
        "index_size": "SELECT 2 * count(*) AS n_rows FROM embeddings",
        "eval_accuracy": f"WITH {_GRADED} SELECT round(avg(same_as_answer::INTEGER), 6) AS accuracy FROM results",
        "eval_source_rate": f"""WITH {_GRADED} SELECT round(avg(find_correct_source::INTEGER), 6) AS source_rate
            FROM results""",
        "longest_document": "SELECT doc_id, text FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1",
        "limit_then_offset": chunk_rows
        + """SELECT * FROM (SELECT doc_id, chunk_no, text FROM chunks ORDER BY doc_id, chunk_no LIMIT 900)
            ORDER BY doc_id, chunk_no OFFSET 850""",
        "fixed_size_batches": chunk_rows
        + """, n AS (SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) AS row_no FROM chunks)
            SELECT doc_id, chunk_no, row_no, (row_no - 1) // 500 AS batch_no FROM n""",
        "fixed_size_batches_full_only": chunk_rows
        + """, n AS (SELECT doc_id, chunk_no, row_number() OVER (ORDER BY doc_id, chunk_no) AS row_no FROM chunks)
            SELECT doc_id, chunk_no, row_no, (row_no - 1) // 500 AS batch_no FROM n
            WHERE (row_no - 1) // 500 < (SELECT count(*) FROM n) // 500""",
        "topk_retrieval": f"""WITH {_NEAR} SELECT question_id, rank, chunk_id, text,
            round(distance, 6) AS distance FROM near""",
        "head_rows": "SELECT item_id AS question_id, text AS question FROM benchmark ORDER BY item_id LIMIT 5",
        "index_merge": """WITH rows AS (SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding,
            lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings)
            SELECT * FROM rows UNION ALL SELECT vec_id, label + 100, norm FROM rows""",
        "index_merge_idempotent": """SELECT vec_id,
            (CASE WHEN vec_id % 3 = 2 THEN label ELSE label + 100 END)::INTEGER AS label,
            greatest(1, 2 - vec_id % 3)::INTEGER AS version FROM embeddings""",
        "index_sync_upsert": f"WITH {_DOC_STATE} SELECT * FROM state",
        "snapshot_changes": f"""WITH {_SNAPSHOTS} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id,
              CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS op,
              2::BIGINT AS version, n.text
            FROM documents o FULL JOIN newer n ON o.doc_id = n.doc_id
            WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text OR o.source IS DISTINCT FROM n.source""",
        "snapshot_sync": f"WITH {_SNAPSHOTS} SELECT doc_id, text, source FROM newer",
        "incremental_index_build": chunk_rows
        + f"""SELECT chunk_id, source, len(list_distinct(list_transform({_words('text')},
            lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM})))::INTEGER AS n_used_dims FROM chunks""",
        "chunk_documents": chunk_rows + "SELECT doc_id, chunk_no, text FROM chunks",
        "chunk_documents_spaced": rf"""WITH cut AS (
              SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS tk FROM documents
            ), starts AS (SELECT doc_id, tk, unnest(range(0, len(tk), {STEP})) AS s FROM cut)
            SELECT doc_id, (s // {STEP})::INTEGER AS chunk_no,
                   array_to_string(tk[s + 1:s + {SIZE}], '') AS text FROM starts""",
        "chunk_documents_no_tail": f"""WITH cut AS (SELECT doc_id, {_tokens('text')} AS tk FROM documents
            ), kept AS (
              SELECT doc_id, tk, list_filter(range(0, len(tk), {STEP}),
                     lambda s: s = 0 OR s + {OVERLAP} < len(tk)) AS ss FROM cut
            ), starts AS (SELECT doc_id, tk, len(ss) AS n, unnest(ss) AS s FROM kept)
            SELECT doc_id, (s // {STEP})::INTEGER AS chunk_no, n::INTEGER AS num_chunks,
                   array_to_string(tk[s + 1:s + {SIZE}], ' ') AS text FROM starts""",
        "chunk_documents_default": f"""WITH {_chunks(size=2000, step=1700)}
            SELECT doc_id, chunk_no, num_chunks, text FROM chunks""",
        "num_chunks": f"""SELECT doc_id, len(range(0, len({_tokens('text')}), {STEP}))::INTEGER AS num_chunks
            FROM documents""",
        "explode_chunks": chunk_rows + "SELECT doc_id, chunk_id, text FROM chunks",
        "text_length": "SELECT doc_id, length(text)::INTEGER AS chars, n_chars FROM documents",
        "embed_text": f"""WITH w AS (SELECT doc_id, unnest({_words('text')}) AS word FROM documents
            ), c AS (
              SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % {DIM})::INTEGER AS bucket,
                     count(*)::DOUBLE AS n FROM w GROUP BY ALL)
            SELECT doc_id, bucket, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5)
              AS weight FROM c""",
        "vector_distance": f"""WITH {_VECS} SELECT q.vec_id, round({l2_self}, 6) AS l2sq,
            round({_COSINE_SELF}, 6) AS cosine, round(-{_dot('q.v', 'i.v')}, 6) AS ip
            FROM vecs q JOIN vecs i ON i.vec_id = q.vec_id + 1""",
        "build_prompt": f"""WITH chat AS (
              SELECT q.conv_id, q.turn, q.text AS question, c.text AS context
              FROM conversations q JOIN conversations c ON c.conv_id = q.conv_id AND c.turn = q.turn + 1)
            SELECT conv_id, turn, 0::INTEGER AS place, 'system' AS role, {_quote(SYSTEM_MESSAGE)} AS content FROM chat
            UNION ALL
            SELECT conv_id, turn, 1::INTEGER, 'human',
                   'Given the context: ' || context || '. Answer the question ' || question || '.' FROM chat""",
        "expand_abbreviations": "SELECT conv_id, turn, "
        + _abbreviated(
            "((CASE WHEN turn % 2 = 1 THEN 'An rpm for MPH? ' ELSE 'WRPM and rpm: ' END) || text)"
        )
        + " AS question FROM conversations",
        "same_as_answer": f"WITH {_GRADED} SELECT eval_id, same_as_answer FROM results",
        "find_correct_source": f"""WITH {_GRADED} SELECT eval_id, source, correct_source,
            find_correct_source FROM results""",
        "json_path_lookup": """SELECT event_id, lower(json_extract_string(props, '$.k')) AS k,
            json_extract_string(props, '$.tags.kind') AS absent,
            lower(event_type) = 'click' AS is_click FROM events""",
        "lookback_window_filter": """SELECT event_id, user_id, event_type FROM events
            WHERE ts::DATE BETWEEN DATE '2024-01-12' AND DATE '2024-01-19'""",
        "daily_snapshot_filter": """SELECT event_id, user_id, event_type FROM events
            WHERE ts::DATE = DATE '2024-01-19'""",
        "split_sql_scripts": rf"""WITH scripts AS (
              SELECT doc_id, '-- first; second' || chr(10) || 'select ' || doc_id::VARCHAR || ';' || chr(10)
                || chr(10) || '  ;' || chr(10) || chr(10) || '  -- only a comment' || chr(10)
                || ';select ''' || text || ''' -- kept' || chr(10) || '  -- gone' AS script FROM documents
            ), pieces AS (
              SELECT doc_id, unnest(string_split(script, ';')) AS piece,
                     generate_subscripts(string_split(script, ';'), 1) AS place FROM scripts
            ), cleaned AS (
              SELECT doc_id, place, regexp_replace(piece, '(?m)^\s*--.*$', '', 'g') AS body FROM pieces
            )
            SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INTEGER AS statement_no,
                   {_strip("body || ';'")} AS statement
            FROM cleaned WHERE {_strip('body')} <> ''""",
        "stream_index_sync": f"""WITH {_DOC_STATE}, {_chunks('state', cols='doc_id, version')}
            SELECT doc_id, version, chunk_id, text FROM chunks""",
        "stream_index_fresh": f"""WITH {_DOC_STATE}, {_chunks('state', cols='doc_id, version')}
            SELECT doc_id, chunk_id, text FROM chunks""",
        "generate_answer": f"WITH {_MADE} SELECT question_id, rank, answer, NULL::VARCHAR AS error FROM made",
        "answer_cascade": f"WITH {_ANSWERED} SELECT * FROM answered",
        "answer_early_stop": f"""WITH {_NEAR}, tried AS (
              SELECT *, length('Given the context: ' || text || '. Answer the question ' || question || '.') AS n
              FROM near
            ), best AS (
              SELECT question_id, 'length ' || n::VARCHAR AS answer, source FROM tried WHERE n % 3 = 0
              QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) = 1)
            SELECT a.question_id, a.question, b.answer, b.source,
                   CASE WHEN b.answer IS NOT NULL THEN 'length' END AS model
            FROM asked a LEFT JOIN best b USING (question_id)""",
        "batch_predict": f"WITH {_ANSWERED} SELECT * FROM answered",
        "stream_index_answers": f"""WITH {_STREAMED_ANSWERS} SELECT question_id, question, answer, source,
            model FROM answered""",
        "grade_answers": f"""WITH said AS (
              SELECT conv_id, turn, text AS answer, CASE turn % 3
                     WHEN 0 THEN ' ' || replace(text, ' ', ' - ') || '!' WHEN 1 THEN text || ' x' END AS prediction
              FROM conversations)
            SELECT conv_id, turn, CASE WHEN coalesce({_FOLDED.format(words=_words('answer'))}
                     = {_FOLDED.format(words=_words('prediction'))}, false)
                   THEN 'CORRECT' ELSE 'INCORRECT' END AS grade FROM said""",
        "evaluate_answers": f"WITH {_EVALUATED} SELECT * FROM evaluated",
        "evaluate_answers_summary": f"""WITH {_EVALUATED} SELECT count(*) AS n_rows,
            round(avg(same_as_answer::INTEGER), 6) AS accuracy,
            round(avg(find_correct_source::INTEGER), 6) AS source_rate FROM evaluated""",
    }
    sql["topk_in_lists"] = sql["topk_retrieval"]
    sql["knn_join_doubled"] = sql["knn_join"]
    sql["stream_index_compact"] = sql["stream_index_sync"]
    sql["stream_index_upsert"] = sql["stream_index_sync"]
    sql["index_reset"] = sql["index_write_read"]
    sql["knn_join_grid"] = sql["knn_join"]
    sql["chunk_udf"] = sql["chunk_documents"]
    sql["index_bucketed_merge"] = sql["index_sync_upsert"]
    sql["index_bucketed_lookup"] = """SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey, p_name
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""
    sql["chunk_table"] = rf"""WITH cut AS (
          SELECT doc_id, {_tokens('text')} AS tk,
                 regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+') AS spaced FROM documents
        ), starts AS (SELECT doc_id, tk, spaced, unnest(range(0, len(tk), {STEP})) AS s FROM cut)
        SELECT doc_id, (s // {STEP})::INTEGER AS chunk_no,
               length(array_to_string(spaced[:s + 1], '')) - length(tk[s + 1]) AS start,
               length(array_to_string(spaced[:s + {SIZE}], '')) AS "end",
               array_to_string(tk[s + 1:s + {SIZE}], ' ') AS text FROM starts"""
    sql["embed_paced"] = """SELECT doc_id, length(text) AS chars,
        length(text) - length(replace(text, ' ', '')) AS spaces FROM documents"""
    sql["expand_from_table"] = rf"""WITH seen AS (
          SELECT word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS word FROM documents)
          WHERE regexp_full_match(word, '[a-z]{{2,4}}') GROUP BY word
        ), pieces AS (
          SELECT conv_id, turn, unnest(p) AS piece, generate_subscripts(p, 1) AS place
          FROM (SELECT conv_id, turn,
                  regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+') AS p FROM conversations)
        ), joined AS (
          SELECT conv_id, turn, string_agg(CASE WHEN n IS NULL THEN piece
                   ELSE upper(word) || ' (seen ' || n || ')' END, '' ORDER BY place) AS text
          FROM pieces LEFT JOIN seen ON lower(piece) = word GROUP BY conv_id, turn)
        SELECT c.conv_id, c.turn, coalesce(j.text, c.text) AS text
        FROM conversations c LEFT JOIN joined j ON c.conv_id = j.conv_id AND c.turn = j.turn"""
    return sql
