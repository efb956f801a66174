"""Token alignment against plain loops over byte ranges."""

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from logwarden.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, batch long, pair long, n_a string"
SF = "/root/testdata/sf0.001"


def byte_letters():
    letters, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            letters[chr(b)] = b
        else:
            letters[chr(256 + extra)] = b
            extra += 1
    return letters


def spans(text, a, b, letters):
    """Ids and byte ranges of both tokenizers' tokens; None if they do not give the text back."""
    def ranges(pieces):
        out, at = [], 0
        for i, piece in pieces:
            out.append((i, at, at + len(piece)))
            at += len(piece)
        return out, b"".join(p for _, p in pieces)

    whole = (" " + (text or "")).encode()
    first = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
    second = [(i, bytes.fromhex(b.id_to_piece(i)[3:5]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
              for i in b.encode(text or "")]
    (xs, one), (ys, two) = ranges(first), ranges(second)
    return (xs, ys) if text and one == two == whole else ([], [])


def plain(rows):
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()
    a.encode_special_tokens = True
    found, counts = [], Counter()
    for i, text in rows:
        xs, ys = spans(text, a, b, letters)
        links = []
        for x, s, e in xs:
            links += [(x, y) for y, f, t in ys if s < t and f < e]
        counts.update(links)
        cuts = sorted({e for _, _, e in xs} & {e for _, _, e in ys})
        groups, low = [], 0
        for cut in cuts:
            groups.append(([x for x, s, e in xs if low <= s < cut], [y for y, s, e in ys if low <= s < cut]))
            low = cut
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((i, len(xs), len(ys), len(groups), links, sum(len(g) * len(h) for g, h in groups),
                      sha256(text.encode()).hexdigest() if text else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, na, nb, ng, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), ns, h)
            for i, na, nb, ng, ls, ns, h in found], found


def rows():
    return [(1, "Hello world, the tokenizers differ!"), (2, None), (3, ""), (4, "a▁b"), (5, "<|endoftext|></s> <unk> <0x41>"),
            (6, "\x00\t\n  é é \U0001F600 漢字"), (7, "Hello world, the tokenizers differ!"), (7, "Hello world"),
            (None, " lead and trail  "), (8, "x"), (9, "abc" * 400), (10, "supercalifragilistic " * 30), (11, "12345 67.89 ​﻿")]


def measures(found):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.n_shared, r.groups_sha256)
                   for r in found.collect()), key=str)


@pytest.mark.parametrize("batch_bytes", [40, 8_000_000])
def test_counted(spark, batch_bytes):
    docs = spark.createDataFrame([(i, t, 7, 8, "n") for i, t in rows()], DOCS).repartition(3)
    assert measures(T.counted(docs, A, B, batch_bytes)) == sorted(plain(rows())[0], key=str)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 3000]
    docs = docs.filter("text IS NULL OR length(text) < 3000")
    assert measures(T.counted(docs, A, B, 50_000)) == sorted(plain(texts)[0], key=str)


def test_links(spark):
    data = [(k, t) for k, (_, t) in enumerate(rows())]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = T.links(docs, A, B).collect()
    _, found = plain(data)
    for i, _, _, _, links, n_shared, _ in found:
        mine = [r for r in got if r.doc_id == i]
        assert sorted((r.a_id, r.b_id) for r in mine if r.kind == "overlap") == sorted(links)
        assert sum(r.kind == "group" for r in mine) == n_shared
    assert {(r.doc_id, r.a_at, r.b_at) for r in got if r.kind == "overlap"} <= {(r.doc_id, r.a_at, r.b_at) for r in got if r.kind == "group"}


def test_row_product():
    rng = np.random.default_rng(3)

    def rows_of(m):
        return T.Rows(np.append(0, np.cumsum((m != 0).sum(1))), np.nonzero(m)[1], m[m != 0], m.shape[1])

    for shape in ((5, 7, 4), (1, 1, 1), (6, 3, 9), (0, 4, 2)):
        x, y = (rng.integers(0, 3, s) for s in (shape[:2], shape[1:]))
        got, want = T.row_product(rows_of(x), rows_of(y)), rows_of(x @ y)
        assert (got.starts == want.starts).all() and (got.at == want.at).all() and (got.values == want.values).all()


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert T.counted(docs, A, B).count() == 0 and T.links(docs, A, B).count() == 0
