"""The prefix trie against SQL, and against a trie built turn by turn."""

import hashlib
import zlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from tallymark.llm import queries as Q
from tallymark.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(convs):
    """Rows of the trie of {conv: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        own = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], digest))
    return sorted(out, key=repr)


def sequences(rows):
    """Conversations in order of turns, null first."""
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def grafts(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def table_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.select("*", *(F.lit("clash").alias(c) for c in ("conv", "pos", "digest", "chars", "key", "depth", "n")))


ROWS = [
    (100, None, "user", "hi"), (100, 0, "assistant", None), (100, 3, None, "same"), (100, 3, None, "same"),
    (101, 1, "user", "hi"), (101, 2, "assistant", ""), (102, 5, "user", "hi"), (103, 1, "us", "erhi"),
    (None, 1, "user", "hi"), (217, 1, "user", "x" * 200_000), (218, 1, "user", "é🙂"), (219, 1, "user", "only"), (5, 0, "user", "hi"),
]


@pytest.mark.parametrize("block", [2, 8192])
def test_odd(spark, block, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_IDS", block)
    rows = ROWS + [(1000 + k, t, "user", f"common {t}") for k in range(60) for t in range(k % 3)] + [(2000 + k, 0, "user", "hi") for k in range(40)]
    df = table_of(spark, rows)
    assert got(trie.prefix_trie(df)) == brute(sequences(rows))
    assert got(trie.grafted_trie(df)) == brute(grafts(sequences(rows)))


def test_deep(spark):
    """Depths around powers of two, and a long shared stem with late forks."""
    rows = [(c, t, "user", f"t{t}" if t < 100 + c else f"{c} {t}") for c, n in ((0, 1), (1, 2), (2, 63), (3, 64), (4, 65), (5, 300), (6, 257)) for t in range(n)]
    assert got(trie.prefix_trie(table_of(spark, rows))) == brute(sequences(rows))


def test_empty(spark):
    assert got(trie.grafted_trie(table_of(spark, []).limit(0))) == []
    assert got(trie.grafted_trie(table_of(spark, [(None, 1, "a", "b")]))) == []


def test_sql(spark, sf):
    with connect(sf) as con:
        assert not differences(spark, con, sf, "op12_trie", Q.op12_trie, trie.SQL)


def test_query_brute(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(Q.op12_trie(spark, sf)) == brute(grafts(sequences(rows)))
