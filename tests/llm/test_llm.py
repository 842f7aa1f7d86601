"""Operators on training data against brute force: small tables with nulls, empties, ties and repeats."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from compare import connect, mismatch
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from askloom.llm import (
    class_lm,
    components,
    line_dedup,
    outliers,
    packing,
    piece_codec,
    quality_model,
    sharding,
    simhash_dedup,
    substring_dedup,
    topk_search,
)
from askloom.llm.oracles import ORACLES

SF_DIR = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, edges string, fingerprint long, slot int"


def made_texts(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(40)] + ["é", "日本", "A", "a", "#", "x|y", "<b>"]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [None, "", "", " \t\n", "one", "Two words", "two words", shared, shared]
    for i in range(n):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))
        texts.append(own if i % 3 else own + "\n" + shared + "  tail " + str(i))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(6000)))
    texts.append(texts[-1] + " more")
    return texts


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 3), len(t or ""), "x", i, 1) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    return made_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


def words_of(text):
    return (text or "").encode().split()


def wide_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Substring dedup


def brute_cut(rows, width):
    first = {}
    for i, text in sorted(rows):
        w = words_of(text)
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    out = {}
    for i, text in rows:
        w = words_of(text)
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()
    return out


@pytest.mark.parametrize("bits", [1 << 24, 1 << 6])
def test_substring_dedup(docs, texts, bits):
    rows = substring_dedup.remove_repeated_spans(docs, 13, bits).collect()
    got = {r.doc_id: (r.cut.n_words, r.cut.n_removed, r.cut.kept_sha256, r.cut.kept_text) for r in rows}
    assert got == brute_cut(list(enumerate(texts)), 13)
    assert sum(v[1] for v in got.values()) > 500
    for r in rows:
        own = words_of(r.text)
        for span in r.cut.spans:
            source = words_of(texts[span.source_id])
            n = span.end - span.start
            assert span.source_id < r.doc_id
            assert own[span.start : span.end] == source[span.source_start : span.source_start + n]


def test_substring_dedup_edges(spark):
    run = " ".join(f"v{i}" for i in range(20))
    rows = [(5, run), (5, run), (3, run), (None, run), (9, None)]
    cut = substring_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    assert cut.columns == ["doc_id", "text", "cut"]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.cut.n_removed) for r in cut.collect())
    assert got == [(-1, 0), (3, 0), (5, 20), (5, 20), (9, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.remove_repeated_spans(empty).collect() == []


# SimHash


def brute_print(text, size):
    w = words_of((text or "").encode().lower().decode())
    shingles = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def test_near_duplicates(docs, texts):
    rows = simhash_dedup.near_duplicates(docs).collect()
    prints = {i: brute_print(t, 3) for i, t in enumerate(texts)}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = groups_of(prints, near)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{p:016x}", roots[i]) for i, p in prints.items()
    }


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    for _ in range(8):
        base = rng.integers(0, 1 << 62, 4, dtype=np.uint64)
        values = base[rng.integers(0, 4, 150)]
        for _ in range(3):
            hit = rng.random(150) < 0.6
            values[hit] ^= np.uint64(1) << rng.integers(0, 64, hit.sum()).astype(np.uint64)
        values = np.unique(values)
        bucket = np.sort(rng.integers(0, 4, len(values)))
        near = [
            (i, j)
            for i in range(len(values))
            for j in range(i)
            if bucket[i] == bucket[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius
        ]
        roots = groups_of(range(len(values)), near)
        assert simhash_dedup.links(bucket, values, radius).tolist() == [roots[i] for i in range(len(values))]


def test_large_buckets_are_cut(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    prints = {base}
    while len(prints) < 120:
        prints.add(rng.choice(sorted(prints)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)))
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(sorted(prints))], "fingerprint long, node long")
    keys = F.array(*simhash_dedup._bucket_keys("fingerprint", 2))
    joined = components.components(simhash_dedup.near_links(nodes, keys, 2, cell=9)).collect()
    values = sorted(prints)
    near = [(i, j) for i in range(120) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    roots = groups_of(range(120), near)
    assert {r.node: r.component for r in joined} == {n: r for n, r in roots.items() if n != r}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert {r.node: r.component for r in got} == want


def test_statistics(docs, texts):
    got = {r.doc_id: r.s for r in docs.select("doc_id", outliers.statistics_column(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        w = wide_words(text)
        lines = [x for x in (text or "").split("\n") if wide_words(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = collections.Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        want = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
        assert tuple(got[i]) == want


def test_outliers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = [f"word{rng.randrange(900)}" for _ in range(rng.randint(60, 300))]
        if i % 40 == 7:
            w = [x + "###$$$%%%" for x in w]
        rows.append((i, " ".join(w), None if i % 2 else "en", "big", 0, "", 0, 0))
    rows += [(1000, None, None, None, 0, "", 0, 0), (1001, "few words", "en", "tiny", 0, "", 0, 0)]
    rows += [(1002, "again and again " * 40, "en", "big", 0, "", 0, 0), rows[0], rows[0]]
    got = outliers.judge_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    failed = {r.doc_id for r in got if r.base_failed}
    assert failed == {1000, 1001, 1002}
    assert {i for i, k in kept.items() if not k} == failed | {i for i in range(400) if i % 40 == 7}
    assert outliers.judge_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_outliers_of_a_source_that_is_mostly_one_text(spark):
    rng = random.Random(14)
    texts = [" ".join(f"word{rng.randrange(900)}" for _ in range(rng.randint(60, 300))) for _ in range(121)]
    texts[7] = " ".join(x + "###$$$%%%" for x in texts[7].split())
    rows = [(i, t, "en", "one", 0, "", 0, 0) for i, t in enumerate(texts + [texts[-1]] * 480)]
    got = outliers.judge_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if not r.kept} == {7}


# Quality classifier


def test_quality_classifier(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        stems = ["tion", "ment", "able"] if good else ["zzk", "qqx", "##!"]
        text = " ".join(rng.choice("abcdef") + rng.choice(stems) + str(rng.randrange(50)) for _ in range(30))
        rows.append((i, text))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (None, "abtion1")]
    labels += [(None, 1), (5, None), (7777, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality_model.score_documents(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        crc = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"")
        assert r.held_out == (crc % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    nothing = quality_model.score_documents(docs, marks.where("doc_id < 0")).collect()
    assert {r.score for r in nothing} == {0.5}


def test_held_out_labels_are_never_learned(spark):
    rows = [(i, f"alpha{i} beta gamma") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    base = [(i, i % 2) for i, _ in rows]
    turned = [(i, 1 - q if i in held else q) for i, q in base]
    scores = [
        sorted((r.doc_id, r.score) for r in quality_model.score_documents(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())
        for x in (base, turned)
    ]
    assert scores[0] == scores[1]


# SentencePiece


def nasty_texts():
    rng = random.Random(5)
    parts = ["a", " ", "  ", "▁", "\n", "\t", "é", "日", "́", "😀", "<s>", "</s>", "<unk>", "<0x41>", "aaaa", "the", "\0", "𐍈", "ﬁ", "⁇", "-" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return texts + ["", " ", "\n", " x", "x ", "a" * 3000, " " * 2000, "ab" * 2000, "-=" * 800]


def test_pieces_equal_the_library():
    codec = piece_codec.codec(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = nasty_texts()
    ids, offsets = codec.encode(texts)
    want = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    assert codec.decode(ids, offsets) == [library.decode(x) for x in want]


def test_decoding_any_ids():
    codec = piece_codec.codec(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    odd = [0, 1, 2, 203, 230, 132, 133, 68, 259, 260, 29871, 35]
    lists = [[rng.choice(odd) if k % 2 else rng.randrange(32000) for _ in range(rng.randint(0, 8))] for k in range(600)]
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
    assert codec.decode(np.array(sum(lists, []), np.int32), offsets) == [library.decode(x) for x in lists]


def test_encode_documents(spark, docs, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in piece_codec.encode_documents(docs, MODEL).collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert piece_codec.encode_documents(spark.createDataFrame([], SCHEMA), MODEL).collect() == []


# Sharding


def test_sharding(docs, texts):
    rows = sharding.shard_by_bytes(docs, 16).collect()
    by_shard, of_text = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        by_shard[r.shard].append(r)
        of_text[data].add(r.shard)
    assert len(rows) == len(texts) and all(len(s) == 1 for s in of_text.values())
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


def test_differencing_is_tight_and_whole():
    rng = random.Random(7)
    sizes = sorted((rng.randint(1, 10_000) for _ in range(2000)), reverse=True)
    shard = sharding.differencing(sizes, 16)
    sums = np.bincount(shard, sizes, 16)
    assert sums.max() - sums.min() <= 10
    assert sharding.differencing([], 16) == [] and sharding.differencing([5], 16) == [0]


def test_shards_of_many_groups_are_even(spark):
    rng = random.Random(8)
    rows = [(i, "y" * rng.randint(0, 400) + str(i)) for i in range(3000)] + [(i, "hot") for i in range(3000, 4500)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    sums = collections.Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert len(sums) == 4 and max(sums.values()) - min(sums.values()) < 20
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA), 4).collect() == []


# Line dedup


def test_line_dedup(spark):
    rows = []
    for i in range(30):
        rows.append((i, f"http://Site.example:80/{i}", f"menu\nown {i}\n\n menu \nnews" if i % 2 else f"menu\nown {i}"))
    rows += [(100 + i, f"https://u@few.example/{i}", "menu\nx") for i in range(4)]
    rows += [(200 + i, None if i % 2 else "no url", "menu") for i in range(10)]
    rows += [(300, "http://site.example/z", None), (301, "http://site.example/z", ""), rows[0], rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, text string").withColumn("host", F.lit("clash"))
    cut = line_dedup.drop_boilerplate(pages, line_dedup.host_of("url"), F.split("text", "\n"), ratio=0.6)
    assert cut.columns == [*pages.columns, "kept_lines", "n_dropped"]
    got = cut.collect()
    assert len(got) == len(rows)
    for r in got:
        lines = r.text.split("\n") if r.text is not None else []
        want = [x for x in lines if x.strip(" ") != "menu"] if r.url and "ite.example" in r.url else lines
        assert r.kept_lines == want and r.n_dropped == len(lines) - len(want)
    small = [(i, "http://two.example/", f"menu\nown {i}") for i in range(2)]
    small += [(10 + i, "http://four.example/", f"{'menu' if i < 2 else 'other'}\nown {i}\nrare {i}") for i in range(4)]
    small += [(20, "http://one.example/", "menu\nmenu")]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(small, "page_id long, url string, text string"),
                                      line_dedup.host_of("url"), F.split("text", "\n"))
    kept = {r.page_id: r.kept_lines for r in got.collect()}
    assert [kept[i] for i in range(2)] == [["own 0"], ["own 1"]] and kept[20] == ["menu", "menu"]
    assert [kept[10 + i] for i in range(4)] == [[f"own {i}", f"rare {i}"] for i in range(4)]
    none = spark.createDataFrame([], "page_id long, url string, text string")
    assert line_dedup.drop_boilerplate(none, line_dedup.host_of("url"), F.split("text", "\n")).collect() == []


def test_page_lines(spark):
    html = "<html><script>var a='<p>';</script><style>p{}</style><!-- x --><P class='a'>One <b>two</b></p><br>  <div>three</div></html>"
    row = spark.createDataFrame([(html, None, "")], "a string, b string, c string")
    assert list(row.select(*(line_dedup.page_lines(c) for c in "abc")).first()) == [["One two", "three"], [], []]


# Packing


def test_packing(spark, docs, texts):
    rows = packing.pack_documents(docs, RANKS, JSON, size=1024).collect()
    library = Tokenizer.from_file(JSON)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum((r.ids for r in own), []) == [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.length == 1024 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert own[-1].offset + own[-1].length <= 1024
    assert len(by_sequence) <= math.ceil(sum(r.length for r in rows) / 1024) + 1
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), RANKS, JSON).collect() == []


@pytest.mark.parametrize("shape", ["short", "long", "one", "few"])
def test_plans_use_up_the_histogram(shape):
    rng = np.random.default_rng(9)
    lengths = {
        "short": rng.integers(1, 200, 20_000),
        "long": rng.integers(500, 1025, 20_000),
        "one": np.full(1000, 400),
        "few": rng.integers(1, 1025, 7),
    }[shape]
    histogram = np.bincount(lengths, minlength=1025)
    plan = packing.plan(histogram)
    used = np.zeros(1025, np.int64)
    for pattern, n in plan:
        assert sum(pattern) <= 1024 and n > 0
        for length in pattern:
            used[length] += n
    assert (used == histogram).all()
    fewest = sum(n for _, n in packing.best_fit(histogram))
    assert sum(n for _, n in plan) <= 1.01 * fewest + 1


def test_odd_texts_have_the_ids_of_the_library():
    encode, library = packing.encoder(RANKS, JSON), Tokenizer.from_file(JSON)
    for text in ["", "a<|endoftext|>b", " " * 50_000, "a" * 20_000, "é\0日本  \t x", "don't 'Tis"]:
        assert list(encode(text)) == library.encode(text, add_special_tokens=False).ids


# Class language model


def test_class_scores(spark, docs, texts):
    training = ~quality_model.held_out("doc_id", 7, 2)
    rows = class_lm.score_texts(docs.union(docs.where("doc_id = 7")), training).collect()
    counts = collections.Counter()
    for i, text in [*enumerate(texts), (7, texts[7])]:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words_of((text or "").encode().lower().decode()), None])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts) + 1
    for r in rows:
        tokens = [*words_of((texts[r.doc_id] or "").encode().lower().decode()), None]
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_rare_words_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HELD", 10)
    rows = [(i, " ".join(f"r{j}" for j in range(i % 9, i % 9 + 30))) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = class_lm.score_texts(table, F.lit(True)).collect()
    counts = collections.Counter(w for _, t in rows for w in t.split())
    counts[None] = 40
    n, v = sum(counts.values()), len(counts)
    for r in got:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in [*rows[r.doc_id][1].split(), None])
        assert r.base_score == pytest.approx(base) and r.n_known == r.n_tokens == 31


def test_class_scores_without_training_or_rows(spark):
    rows = class_lm.score_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), F.lit(False))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[2].n_tokens == 1
    assert class_lm.score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_classes_beat_unigrams(spark):
    rng = random.Random(10)
    sides = [[f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]]
    rows = [(i, " ".join(rng.choice(sides[k % 2]) for k in range(80))) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = class_lm.score_texts(table, ~quality_model.held_out("doc_id", 7, 2)).where("held_out").collect()
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 10 * len(got)


# Top-k


def brute_top(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    def held(score):
        return min(max(score, -(1 << 63)), (1 << 63) - 1)

    vectors = [(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None]
    out = {}
    for q, v in ((i, v) for i, v in vectors if i in queries):
        scored = sorted((-held(sum(a * b for a, b in zip(v, w))), i) for i, w in vectors if i != q and len(w) == len(v))
        out[q] = [(rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("scale", [1.0, 3e6, 1e15])
def test_exact_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk_search, "FAN", 2)
    monkeypatch.setattr(topk_search, "GROUP_BYTES", 400)
    rng = random.Random(11)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.7]) * scale for _ in range(5)]) for i in range(150)]
    rows += [(200, None), (201, [1.0, None, 2.0, 0.0, 0.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5)]
    rows += [(204, [1.0, 2.0]), (205, [3.0, 4.0]), (None, [1.0] * 5), (300, [0.7 * scale] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    queries = {0, 10, 204, 200, 202}
    got = collections.defaultdict(list)
    for r in topk_search.exact_top_k(table, table.where(F.col("vec_id").isin(*queries)), 10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = brute_top(rows, queries, 10)
    assert {q: sorted(x) for q, x in got.items()} == {q: x for q, x in want.items() if x}


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.exact_top_k(none, none).collect() == []


# Registration and pipeline


def test_fourteen_queries_are_registered():
    names = registry.queries()
    assert [n for n in range(1, 14) if sum(x.startswith(f"op{n}_") for x in names) != 1] == []
    assert "pipeline" in names and set(ORACLES) <= set(names)


COLUMNS = {
    "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", *outliers.NAMES, "base_failed", "kept"],
    "op4": ["doc_id", "held_out", "score", "predicted"],
    "op5": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op12": ["doc_id", "held_out", "score", "predicted"],
}


@pytest.mark.parametrize("op", sorted(COLUMNS))
def test_registered_query_has_a_row_for_every_document(spark, op):
    (run,) = (q for n, q in registry.queries().items() if n.startswith(f"{op}_"))
    rows = run(spark, SF_DIR)
    assert rows.columns[: len(COLUMNS[op])] == COLUMNS[op]
    ids = [r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows.collect()) == sorted(ids)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert mismatch(registry.queries()[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == columns, name
        rows = kept.collect()
        assert 0 < len(rows) <= before
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_pipeline_keeps_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "alone here"), (3, "alone here"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, SF_DIR).collect()) == ["1", "3", "None", "None"]
    for stage in (corpus_pipeline.drop_boilerplate_lines, corpus_pipeline.drop_repeated_spans):
        assert sorted(map(str, stage(spark, docs, SF_DIR).collect())) == sorted(map(str, docs.collect()))
    for stage in corpus_pipeline.STAGES:
        assert stage[1](spark, docs.limit(0), SF_DIR).collect() == []
