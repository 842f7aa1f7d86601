"""Every stage of the pipeline, and the whole run, against brute force on a planted corpus."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm import JSON, brute_cut, brute_print, groups_of
from tokenizers import Tokenizer

import corpus_pipeline
from askloom.llm import line_dedup, quality_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(seed=4):
    """Rows (doc_id, text, source, quality) with junk, boilerplate, near and exact copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(900)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [" ".join(prose(60)) for _ in range(3)]
    rows = []
    for i in range(300):
        source = f"s{i % 6}" if i % 11 else None
        if i % 5 == 0:
            rows.append((i, " ".join(rng.choice(["zz", "yy", "$$$"]) for _ in range(rng.randint(20, 80))), source, 0))
            continue
        lines = [" ".join(prose(rng.randint(5, 40))) for _ in range(rng.randint(1, 5))]
        if i % 6 in (1, 2):
            lines.insert(rng.randrange(len(lines) + 1), f"all rights of s{i % 6} reserved")
        if i % 7 == 0:
            lines.append(passages[i % 3])
        rows.append((i, "\n".join(lines), source, 1))
    good = [r for r in rows if r[3] == 1]
    for k, (_, text, source, _) in enumerate(good[:40]):
        words = text.split(" ")
        if k % 2 and len(words) > 60:
            words[rng.randrange(len(words))] += "x"
        rows.append((1000 + k, " ".join(words), source, 1))
    return rows + [(2000, None, "s1", 1), (2001, "", None, 1), (2002, "", "s2", 1)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("planted"))
    rows = planted()
    docs = [(i, t, "en", s, len(t or "")) for i, t, s, _ in rows]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    labels = [(i, q, 0) for i, _, _, q in rows if i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    return sf_dir, [r[:3] for r in rows], {i: q for i, q, _ in labels}


def brute_good(rows, labels):
    known = sorted((i, t) for i, t, _ in rows if i in labels and zlib.crc32(str(i).encode()) % 5)
    texts = pa.array([t for _, t in known], pa.string())
    model = quality_model.train(texts, np.array([labels[i] for i, _ in known]))
    return [(i, t, s) for i, t, s in rows if model.scores(pa.array([t], pa.string()))[0] >= 0.3]


def brute_lines(rows):
    pages = collections.defaultdict(set)
    for _, text, source in rows:
        if source:
            pages[source].add(tuple((text or "").split("\n")) if text is not None else ())
    out = []
    for i, text, source in rows:
        lines = [] if text is None else text.split("\n")
        kept = []
        for line in lines:
            n = sum(any(x.strip(" ") == line.strip(" ") for x in page) for page in pages.get(source, ()))
            common = n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * len(pages.get(source, ()))
            kept += [] if common and line.strip(" ") else [line]
        out.append((i, "\n".join(kept) if len(kept) < len(lines) else text, source))
    return out


def brute_near(rows):
    prints = {i: brute_print(t, 3) for i, t, _ in rows}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = groups_of(prints, near)
    return [r for r in rows if roots[r[0]] == r[0]]


def brute_spans(rows):
    cut = brute_cut([(i, t) for i, t, _ in rows], 13)
    return [(i, cut[i][3] if cut[i][1] else t, s) for i, t, s in rows]


def rows_of(df):
    return sorted((r.doc_id, r.text, r.source) for r in df.collect())


def check_packed(packed, rows):
    """Every document's tokens, whole and in order, in sequences of at most 1024 without a gap."""
    encoder = Tokenizer.from_file(JSON)
    encoder.encode_special_tokens = True
    ids = {i: encoder.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            mine = np.array(ids[i][at : at + r.length], "<u4").tobytes()
            assert r.start == at and r.ids_crc32 == zlib.crc32(mine)
            at += r.length
        assert at == len(ids[i])
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(sequences) <= least + max(2, least // 20)


def test_stages_and_run_equal_brute_force(spark, corpus):
    sf_dir, rows, labels = corpus
    stages = [f for _, f in corpus_pipeline.STAGES]
    brutes = [lambda x: brute_good(x, labels), brute_lines, brute_near, brute_spans]
    now, sizes = rows, [len(rows)]
    for stage, brute in zip(stages, brutes):
        docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in now], DOCS).repartition(3)
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        want = sorted(brute(now), key=lambda r: r[0])
        assert rows_of(kept) == want
        assert want != sorted(now, key=lambda r: r[0])  # each stage has something to do here
        now = want
        sizes.append(len(now))
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] == sizes[4] > 150
    check_packed(corpus_pipeline.run(spark, sf_dir).collect(), now)


def test_rows_of_one_id_are_one_document(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, one, "x"), (7, one, "y"), (7, two, "x"), (9, two, "x"), (3, "other words", "x"), (None, one, "x"), (None, one, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, __hash int").repartition(4)
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == {(7, one): 1, (7, two): 1, (3, "other words"): 1, (None, one): 2}
    again = corpus_pipeline.keep_one_of_each_group(spark, docs.repartition(2), "")
    assert sorted(map(str, again.collect())) == sorted(map(str, kept.collect()))
