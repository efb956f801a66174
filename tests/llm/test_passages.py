"""Passages without full stops, and of other scripts, are found wherever in a sentence they begin."""

import random
import string

import pytest
from test_brute import table

from logwarden.llm import sentence_dedup


def shared(a, b):
    """Whether two texts have a run of sentences in common."""
    x, y = (sentence_dedup.run_hashes(sentence_dedup.sentences(t.encode()), 3, 10)[1] for t in (a, b))
    return bool(set(x.tolist()) & set(y.tolist()))


@pytest.mark.parametrize(("n", "least"), [(51, 0.95), (60, 0.98), (80, 0.99), (120, 0.99)])
def test_random_offsets(n, least):
    rng = random.Random(n)
    fresh = lambda k: " ".join("".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(k))
    found = 0
    for _ in range(300):
        passage = fresh(n)
        found += shared(*(f"{fresh(rng.randrange(1, 40))} {passage} {fresh(rng.randrange(1, 40))}" for _ in range(2)))
    assert found >= least * 300


def test_other_scripts(spark):
    rng = random.Random(4)
    char = lambda k: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(k))
    for passage in ("".join(char(12) + "。" for _ in range(6)), char(150)):
        docs = [(i, char(rng.randrange(5, 40)) + passage + char(rng.randrange(5, 40))) for i in range(4)]
        got = {r.doc_id: r.text for r in sentence_dedup.spans(table(spark, docs)).collect()}
        assert got[0] == docs[0][1]
        assert all(len(docs[i][1]) - len(got[i]) > len(passage) // 2 for i in range(1, 4))
    for text in ("नमस्ते दुनिया। फिर मिलेंगे। ठीक है।", "مرحبا؟ نعم۔ لا", "。。a. b\n\n c  ", "ab " * 50, "\n x"):
        assert b"".join(sentence_dedup.sentences(text.encode())).decode() == text
    assert len(sentence_dedup.sentences("नमस्ते दुनिया। फिर मिलेंगे। ठीक है।".encode())) == 3
