"""The conversation trie against a plain walk over all prefixes and against SQL; cuts between blocks, tasks and copies."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tidemark.llm import turn_trie as T

SMALL = "/root/testdata/sf0.001"
ROWS = "conv_id LONG, turn LONG, role STRING, text STRING, seq STRING, key INT"


def brute_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])
        out[c] = base[:h] + v[h:]
    return out


def brute(convs):
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    size = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in nodes.items()}
    kids = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += size[p]
            leaves[p[:d]] += not kids[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in nodes.items()), key=repr)


def made(rng, n, kinds=3, long=6):
    """Few kinds of turns, so that paths are shared, end inside each other and repeat."""
    return [(c, t, rng.choice(["user", "bot"])[: t % 2 * 4], "x" * rng.randrange(kinds)) for c in rng.sample(range(-20, 4 * n), n) for t in range(rng.randrange(long))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS).repartition(3)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bits,parts", [(1, 5), (3, 1), (4, 7), (4096, None)])
def test_blocks_and_cuts(spark, bits, parts):
    rng = random.Random(bits)
    rows = made(rng, 60) + [(1000 + c, t, "user", "the same first turn") for c in range(25) for t in range(3)] + [(2000 + c, 0, "user", "the same first turn") for c in range(9)]
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    df = T.plain(frame(spark, rows))
    assert got(T.trie(df, bits, parts)) == brute(convs)


@pytest.mark.parametrize("bits,parts", [(2, 3), (64, 2), (4096, None)])
def test_rebuilt(spark, bits, parts):
    rng = random.Random(7)
    rows = made(rng, 50, 4, 12)
    rows += [(None, 1, "user", "no conversation"), (7, None, None, None), (7, None, "user", "é" * 50), (7, 3, "user", "twice"), (7, 3, "user", "twice"), (8, 0, "bot", "long " * 50_000), (9, 0, "", "")]
    rows += [(500 + c, t, "user", f"turn {t}") for c in range(0, 40) for t in range(10)] + [(5000, t, "user", f"deep {t % 7}") for t in range(700)]
    assert got(T.trie(T.rebuilt(frame(spark, rows)), bits, parts)) == brute(brute_rebuilt(rows))


def test_empty_and_turnless(spark):
    assert got(T.query(frame(spark, [(None, 1, "user", "x")]))) == []
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    c = next(c for c in range(1, 99) if c % 5 and h(c) > 0)
    none = hashlib.sha256(str(c).encode()).hexdigest()
    assert got(T.query(frame(spark, [(c, 0, "user", "gone, and its base is absent")]))) == [(c, 0, None, 1, 0, 1, 0, none)]


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    assert got(T.query(spark.read.parquet(f"{SMALL}/conversations.parquet"))) == sorted(con.execute(T.oracle()).fetchall(), key=repr)
