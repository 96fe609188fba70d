"""Tries against brute force over lists of turns, with awkward rows and with every shard, band and heavy level forced."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from tessella.llm.common import Scratch
from tessella.llm.op13_trie import ORACLE_SQL, op13_trie
from tessella.llm.trie import Louds, TrieParams, ordered, parents_of, trie

SCHEMA = "conv_id long, turn long, role string, text string, label string, chars int, at string, depth long, n long, k1 string"
SMALL = [TrieParams(), TrieParams(heavy=3, share=1 << 30, band=3, shard=4), TrieParams(heavy=1, share=1 << 30, band=2, shard=1), TrieParams(heavy=20, share=1 << 30, band=1, shard=1000)]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = (len(members[path]) - 1) * len(path[-1][1] if path else "") + sum(saved[k] for k in below)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def conversations(seed=1):
    rng = random.Random(seed)
    said = [("user", "hello"), ("user", ""), (None, "hello"), ("assistant", None), ("u", "ser:"), ("us", "er:"), ("user", "naïve \U0001f600"), ("system", "x" * 5000)]
    rows = []
    for c in [*range(0, 40), *range(95, 130), *range(-120, -95), 5000, 10**15 + 7]:
        n = rng.choice((1, 1, 2, 3, 8, 14))
        first = rng.random() < 0.5
        for t in range(n):
            role, text = said[0] if first and t < 3 else rng.choice(said)
            rows.append((c, rng.choice((t, t, t, None, 3)), role, text))
    rows += [(7, 2, "user", "again")] * 3 + [(None, 1, "user", "nobody's"), (8, None, None, None)]
    # copies of a whole conversation
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 230) for t in range(12)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, "a", 2, 3, "k") for r in rows], SCHEMA).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: (r[0], r[1], r[2] is not None, r))


@pytest.mark.parametrize("p", SMALL)
def test_trie_is_brute_force(spark, tmp_path, p):
    rows = conversations()
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(op13_trie(spark, str(tmp_path), p)) == sorted(brute(rebuilt(rows)), key=lambda r: (r[0], r[1], r[2] is not None, r))


def test_sql_is_brute_force(tmp_path, spark):
    rows = conversations(2)
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        got = db.sql(ORACLE_SQL["op13_trie"]).fetchall()
    assert sorted(got, key=lambda r: (r[0], r[1], r[2] is not None, r)) == sorted(brute(rebuilt(rows)), key=lambda r: (r[0], r[1], r[2] is not None, r))


def test_empty_table_and_one_long_conversation(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert op13_trie(spark, f"{tmp_path}/none").count() == 0
    # more turns than a block of running sums, all of one number, a third of them equal
    rows = [(1, 5, "user", f"{max(0, t - 3000)}") for t in range(9000)] + [(2, t, "user", "x") for t in range(3)]
    scratch = Scratch(spark, "long")
    turns = ordered(frame(spark, rows), scratch)
    lengths = turns.groupBy("conv_id").count().withColumnRenamed("count", "length")
    got = rows_of(trie(lengths, turns.join(lengths, "conv_id"), scratch, TrieParams(band=2500, shard=1000)))
    own = {c: [x[1:] for x in sorted((digest(r, t), r, t) for d, _, r, t in rows if d == c)] for c in (1, 2)}
    assert got == sorted(brute(own), key=lambda r: (r[0], r[1], r[2] is not None, r))


def test_louds_navigates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        parent = np.array([int(rng.integers(-1, i)) for i in range(n)])
        depth = np.zeros(n, np.int64)
        for i in range(n):
            depth[i] = 3 if parent[i] < 0 else depth[parent[i]] + 1
        mixed = rng.permutation(n)
        place = np.argsort(mixed)
        moved = np.where(parent[mixed] < 0, -1, place[parent[mixed]])
        t = Louds(depth[mixed], moved)
        back = mixed[t.order]
        up = t.parents()
        assert [(-1 if u < 0 else back[u]) for u in up] == parent[back].tolist()
        assert (np.diff(up) >= 0).all() and t.degrees().tolist() == [int((parent == b).sum()) for b in back]
        values = rng.integers(0, 9, n)
        total = values.copy()
        for i in reversed(range(n)):
            if parent[i] >= 0:
                total[parent[i]] += total[i]
        assert t.add_up(values[back]).tolist() == total[back].tolist()


def test_parents_need_both_halves_of_a_key():
    k1, k2 = np.array([1, 1, 2, 1]), np.array([1, 2, 1, 3])
    assert parents_of(k1, k2, np.array([9, 1, 1, 2]), np.array([9, 1, 2, 2])).tolist() == [-1, 0, 1, -1]
