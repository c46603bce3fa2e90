"""Operator 12 against a trie built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest

from quayside.llm import prefix_trie as pt
from quayside.llm.registry import OP12_SQL


def plain_trie(rows):
    found = {}
    for conv_id, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(conv_id, []).append((role or "", text or ""))
    new = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = found.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members = {}
    for c, s in new.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        mine = members[p]
        below = [out[k] for k in kids.get(p, ())]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in mine if len(new[c]) == len(p))))
        out[p] = (min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), len(below), sum(b[5] for b in below) or 1, (len(mine) - 1) * words + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, x long, depth string, part long"


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 90), 70):
        turns = list(range(rng.choice((0, 1, 1, 2, 3, 5, 9))))
        rows += [(c, t, rng.choice(("user", "user", "assistant", None, "")), rng.choice(("hi there", "hi there", "a b c", None, "", " \n", "é"))) for t in turns]
    rows += [(500, t, "user", f"long {t % 3}") for t in range(900)]  # most rows are one conversation
    rows += [(505, t, "user", f"long {t % 3}") for t in range(700)]
    rows += [(41, None, "user", "null turn"), (41, None, "user", "null turn"), (None, 1, "user", "no id"), (None, None, None, None)]
    rows += [(600 + 20 * k, t, "user", "same" if t < 2 else "end") for k in range(60) for t in range(3)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_plain_code(spark, seed, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 10)
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, pt.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


def test_few_and_no_rows(spark):
    for rows in ([], [(None, 1, "user", "x")], [(7, 1, "user", "x")], [(27, t, "user", "x") for t in range(2)]):
        df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
        assert sorted(map(tuple, pt.prefix_trie(df).collect()), key=repr) == plain_trie(rows)


def test_query_against_plain_code_and_sql(spark):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, pt.op12_prefix_trie(spark, "/root/testdata/sf0.01").collect()), key=repr) == plain_trie(rows)
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert sorted(con.execute(OP12_SQL).fetchall(), key=repr) == plain_trie(rows)
