"""Token counts, packing and pieces against the libraries."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpora.llm import packing, pieces, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "", " ", None, "Hello, World! don't we'll I'VE 123 4½ x²", "İstanbul ΣΟΦΟΣ ǅ ﬁ ß", "á é é", "tab\tnew\nline\r\n",
    "<|endoftext|> in a text", "<|startoftext|>", "< |endoftext| >", "\x1c\x85\xa0 wide", "日本語 テスト", "😀👍🏽", "a" * 3000,
    "don't" * 400, "##%% $$$", "naïve café — “quotes” … €5", "_under_score_ a_b", "\x00\x01",
]


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def given(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    return HARD + [r.text for r in rows]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts_are_the_library_s(spark, given, path):
    encode = library(path)
    for r in token_counts.token_counts(documents(spark, given), path, limit=100).collect():
        text = given[r.doc_id] or ""
        n = len(encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100), text[:40]


def test_counts_do_not_depend_on_the_table(spark, given):
    docs = documents(spark, given)
    one = token_counts.token_counts(docs, WORDS, table={}).orderBy("doc_id").collect()
    assert one == token_counts.token_counts(docs, WORDS).orderBy("doc_id").collect()


def test_counts_of_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")
    docs = docs.withColumn("n", F.lit(1)).withColumn("t", F.lit(2))
    out = token_counts.token_counts(docs, WORDS)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 0, False), (1, 0, 0, False), (None, 1, 1, False)]
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


def test_packing(spark, given):
    encode, size = library(WORDS), 64
    out = packing.pack_documents(documents(spark, given), WORDS, size=size, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, text in enumerate(given):
        ids = np.array(encode(text) + [0], dtype="<u4")
        rows = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(-(-len(ids) // size)))
        for r in rows:
            own = ids[r.start : r.start + r.length].tobytes()
            assert r.start == r.piece * size and bytes(r.ids) == own and r.ids_crc32 == zlib.crc32(own)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    total = sum(r.length for r in out)
    assert len(by_sequence) <= 1.05 * -(-total // size) + 1


@pytest.mark.parametrize("kind", ["even", "long", "few", "ones", "full"])
def test_plan_places_every_piece_once(kind):
    rng, size = random.Random(kind), 100
    draw = {
        "even": lambda: rng.randint(1, 100), "long": lambda: min(100, int(rng.lognormvariate(3, 1)) + 1),
        "few": lambda: rng.choice([34, 33, 50, 7]), "ones": lambda: 1, "full": lambda: 100,
    }[kind]
    counts = Counter(draw() for _ in range(5000))
    used, runs = defaultdict(list), defaultdict(list)
    for run in packing.packing_plan(counts, size):
        runs[run[0]].append(run)
    for length, own in runs.items():
        ends = [r[1] for r in own[1:]] + [counts[length]]
        assert own[0][1] == 0
        for (_, first, sequence, offset), end in zip(own, ends):
            for rank in range(first, end):
                used[sequence + rank - first].append((offset, length))
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    assert sum(map(len, used.values())) == 5000
    lower = -(-sum(l * n for l, n in counts.items()) // size)
    assert len(used) <= 1.03 * lower + 1


def test_ranks_of_one_hot_length(spark):
    rows = spark.range(5000).select(F.col("id"), F.lit(0).alias("piece"), F.lit(7).cast("long").alias("length"))
    assert sorted(r["rank"] for r in packing.ranked(rows).collect()) == list(range(5000))


def test_packing_of_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    docs = docs.withColumn("length", F.lit(1)).withColumn("id", F.lit(2))
    out = packing.pack_documents(docs, WORDS, size=8).collect()
    assert sorted((r.doc_id or 0, r.length) for r in out) == [(0, 1), (1, 2), (1, 2)]
    assert len({(r.sequence_id, r.offset) for r in out}) == 3
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("chunk", [40, 700, 1 << 16])
def test_pieces_are_the_library_s(spark, given, processor, chunk):
    rng = random.Random(1)
    texts = given[:60] + ["日本語テスト中国" * 60, "http://www.example.com/" * 40, " " * 300 + "x", "▁a ▁"]
    texts.append("".join(rng.choice("etaoinshrdlu") for _ in range(2500)))
    out = pieces.decode(pieces.encode(documents(spark, texts), MODEL, chunk=chunk), MODEL).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == processor.encode(text)
        assert r.text == text.replace("▁", " ") and r.n_tokens == len(processor.encode(text))
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))


def test_merging_is_the_library_s(processor):
    own, rng = pieces.load(MODEL), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 25)))
        ids = np.frombuffer(own.packed(own.merged("▁" + word)), "<u4").tolist()
        assert ids == processor.encode(word)


def test_boundary_states_are_of_the_best_path():
    rng = np.random.default_rng(5)
    shapes = [1, 3, 4, 2, 5, 3, 1]
    matrices = [rng.integers(0, 1000, (a, b)).astype(float) for a, b in zip(shapes, shapes[1:])]
    path = pieces.boundary_states(matrices)
    best = matrices[0]
    for m in matrices[1:]:
        best = pieces.product(best, m)
    assert sum(m[a, b] for m, a, b in zip(matrices, path, path[1:])) == best.max() and len(path) == 7


def test_pieces_of_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, "ab " * 40), (1, "ab " * 40)], "doc_id long, text string")
    docs = docs.withColumn("ids", F.lit(1)).withColumn("name", F.lit(2))
    out = pieces.decode(pieces.encode(docs, MODEL, chunk=50), MODEL).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, ""), (1, "ab " * 40), (1, "ab " * 40)]
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
