"""Alignment of tokens against a brute-force version that uses the libraries alone."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpora.llm import alignment

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ZEROS = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(rest)}


def cuts(libraries, text):
    """Ids and end places of both, or None."""
    if not text:
        return None
    one, two = libraries
    letters, whole = byte_letters(), (" " + text).encode()
    ids_a, ids_b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    parts_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in ids_a]
    names = [two.id_to_piece(i) for i in ids_b]
    parts_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, names)]
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return None
    return [(ids, [sum(map(len, parts[: n + 1])) for n in range(len(parts))]) for ids, parts in ((ids_a, parts_a), (ids_b, parts_b))]


def brute(libraries, texts):
    groups, held = [], Counter()
    for text in texts:
        found = cuts(libraries, text)
        own = []
        if found:
            (ids_a, ends_a), (ids_b, ends_b) = found
            low = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                own.append([[i for i, e in zip(ids, ends) if low < e <= end] for ids, ends in found])
                low = end
        groups.append(own)
        held.update({(a, b) for one, two in own for a in one for b in two})
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    out = []
    for own in groups:
        links = [(a, b) for one, two in own for a in one for b in two]
        digest = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, two)) for one, two in own)
        out.append((
            sum(len(one) for one, _ in own), sum(len(two) for _, two in own), len(own), len(links),
            sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
            hashlib.sha256(digest.encode()).hexdigest() if own else "",
        ))
    return out


def result(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(alignment.token_alignment(docs, A, B, **options).collect())
    return [tuple(r[1:]) for r in rows]


ODD = [
    "", " ", "  two  blanks ", "\n", "a\nb \n c", "tab\tand\x0bmore\x0c", "x\x1cy z\x1f", "café naïve ☃ 你好",
    "a▁b", "<|endoftext|> and </s> <unk> <0x41>", "\U0001f600\U0001f600 family", "word word　w  x",
    "é combining", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "1234567890 3.14159 1,000,000", "it's we'll I'd THEY'RE",
    "\x00null and \x07bell", "﻿bom", "​zero‍width", "    deep\n\n\n    indent  ", "-----=====#####", "ﷺ ﬁligature", "a  \n  b",
]


def test_odd_texts_and_repeats(spark, libraries):
    texts = ODD + ["the same text"] * 3 + [None]
    assert result(spark, texts) == brute(libraries, texts)


def test_given_documents_and_rare_pairs(spark, libraries):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    texts = [r.text for r in rows]
    want = brute(libraries, texts)
    assert result(spark, texts) == want
    assert result(spark, texts, table_size=200) == want  # most pairs go the second way


def random_ends(rng, last):
    return sorted({*rng.sample(range(1, last), rng.randint(0, min(40, last - 1))), last})


def test_groups_of_random_ends():
    rng = random.Random(3)
    for _ in range(400):
        last = rng.randint(2, 60)
        a, b = random_ends(rng, last), random_ends(rng, last)
        if rng.random() < 0.3:
            b = sorted({*a} ^ {x for x in rng.sample(a, min(2, len(a))) if x != last})
        groups = alignment.Groups(np.arange(len(a)), np.arange(len(b)), a, b)
        bounds = [zip([0, *x[:-1]], x) for x in (groups.to_a.tolist(), groups.to_b.tolist())]
        got = [(a[p:q], b[r:s]) for (p, q), (r, s) in zip(*bounds)]
        want, low = [], 0
        for end in sorted({*a} & {*b}):
            want.append(tuple([e for e in ends if low < e <= end] for ends in (a, b)))
            low = end
        assert got == want and len(groups) == len(want)


def test_long_text(spark, libraries):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdeé \n.") for _ in range(rng.randint(1, 9))) for _ in range(1500))
    assert result(spark, [text, text + "!"]) == brute(libraries, [text, text + "!"])


def test_nulls_clashes_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "some text"), (1, None), (1, "")], "doc_id long, text string")
    docs = docs.withColumn("pairs", F.lit(1)).withColumn("row", F.lit("x")).withColumn("id", F.lit(2)).withColumn("n", F.lit(0))
    rows = sorted(map(tuple, alignment.token_alignment(docs, A, B).collect()), key=lambda r: r[0] or 0)
    assert rows[0][0] is None and rows[0][1] == 2 and [r for r in rows[1:]] == [(1, *ZEROS)] * 2
    assert alignment.token_alignment(docs.limit(0), A, B).count() == 0
