"""The Merkle manifest against a plain recursive tree, with blocks of three and nine leaves."""

from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import merkle_manifest as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree int, rank int, hash string"


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha256("".join(now[i:i + 3]).encode()).hexdigest() for i in range(0, len(now), 3)])
    return levels


def plain_steps(levels, i):
    found = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3:i // 3 * 3 + 3]
        found.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        i //= 3
    return found


def plain_leaf(row, text):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text))
                  .encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80])
def test_places(n):
    leaves = [sha256(str(i).encode()).hexdigest() for i in range(n)]
    levels = plain_levels(leaves)
    top = len(levels) - 1
    log = [x.decode() for x in M.append_log([x.encode() for x in leaves], top)]
    assert len(log) == sum(map(len, levels)) and log[-1] == levels[-1][0]
    for level, nodes in enumerate(levels):
        assert [log[p] for p in M.place_in_log(level, np.arange(len(nodes)), n, top)] == nodes
    done = {}
    for place, node in enumerate(log):  # every node stands after all nodes below it
        done[node] = place
    for level in range(top):
        assert all(done[x] < done[levels[level + 1][i // 3]] for i, x in enumerate(levels[level]))


def rows():
    out = [(i, f"t{i}\n{i * i}", "en", f"s{i % 3}", 5, 1, 2, "h") for i in range(41)]
    out += [(100 + i, None if i % 2 else "", None, None, None, 1, 2, "h") for i in range(5)]
    out += [(7, "t7\n49", "en", "s1", 5, 1, 2, "h"), (7, "other\n", "en", "s1", 5, 1, 2, "h"), (None, "x\ny", "de", "s1", 3, 1, 2, "h"),
            (None, "x\ny", "de", "s1", 3, 1, 2, "h"), (200, "long \n" * 30_000, "é", "ü", 0, 1, 2, "h"), (201, "a", "en", "", 1, 1, 2, "h")]
    return out


@pytest.mark.parametrize("span", [3, 9, 729])
def test_manifest(spark, span):
    data = rows()
    docs = spark.createDataFrame(data, DOCS).repartition(7)
    now = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    got = M.proofs(M.build(docs, now, span)).withColumn(
        "folded", M.folded(F.coalesce("now", "leaf"), F.col("lefts"), F.col("rights"))).collect()
    by_source = {}
    for row in data:
        by_source.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, plain_leaf(row, row[1]), row))
    ordered = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([leaf for _, _, leaf, _ in sorted(by_source[s], key=lambda x: x[:3])]) for s in ordered}
    over = plain_levels([trees[s][-1][0] for s in ordered])
    expected = []
    for k, s in enumerate(ordered):
        for i, (_, _, leaf, row) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            steps = plain_steps(trees[s], i) + plain_steps(over, k)
            changed = plain_leaf(row, row[1] and row[1].replace("\n", ""))
            node = changed
            for a, b in steps:
                node = sha256((a + node + b).encode()).hexdigest()
            expected.append((row[0], leaf, None if changed == leaf else changed, trees[s][-1][0], over[-1][0],
                             [a for a, _ in steps], [b for _, b in steps], node))
    key = lambda r: (str(r[0]), r[1], str(r[5:7]))
    assert sorted(((r.doc_id, r.leaf, r.now, r.subroot, r.root, r.lefts, r.rights, r.folded) for r in got), key=key) \
        == sorted(expected, key=key)
    assert any(r.folded != r.root for r in got) and all((r.folded == r.root) == (r.now is None) for r in got)


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert M.audit(docs, F.col("text")).count() == 0


def test_one_row(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1, 1, 2, "h")], DOCS)
    row = M.audit(docs, F.col("text")).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == sha256(b"").hexdigest()
