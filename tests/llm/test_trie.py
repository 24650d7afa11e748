import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import queries, trie

TURNS = "conv_id long, turn long, role string, text string, pos string, label int, name string, turns int"


def conversations(seed, n, vocabulary, copies):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 5 * n), n):
        k = rng.choice([1, 2, 3, 8, 9, 14])
        for turn in range(k):
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.1 else "user", f"t{rng.randrange(vocabulary)}é" if rng.random() < 0.95 else None))
    for c in range(6 * n, 6 * n + copies):
        rows += [(c, t, "user", f"hot {t}") for t in range(12)]
    rows += [(8 * n, None, "user", "first"), (8 * n, 3, "b", "x"), (8 * n, 3, "a", "y"), (8 * n, 3, "a", "y"), (None, 0, "user", "no conversation"), (8 * n + 1, None, None, None)]
    rows += [(8 * n + 5, t, "user", f"t{t % 3}") for t in range(300)] + [(8 * n + 6, 0, "user", "long " * 100_000)]
    rng.shuffle(rows)
    return rows


def rebuilt(rows):
    order = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            order[c].append((turn is not None, turn or 0, role, label, (role, text)))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in order.items()}
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        start = c - int(np.fmod(c, 5))
        out[c] = turns.get(start, [])[:h] + turns[c][h:]
    return out


def plain(convs):
    """Nodes of a trie of dictionaries."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = own + sum(saved[k] for k in children[path])
    rows = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(path)))
        rows.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def result(df):
    nodes = trie.prefix_trie(trie.shared_starts(trie.turns_of(df)))
    return [(*r[:-1], r[-1].hex()) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends").collect()]


@pytest.mark.parametrize("heavy,shard,step,piece", [(trie.HEAVY, trie.SHARD, trie.STEP, trie.PIECE), (3, 40, 1, 7), (1, 1000, 2, 1)])
def test_tries_equal_plain_ones(spark, monkeypatch, heavy, shard, step, piece):
    for name, value in (("HEAVY", heavy), ("SHARD", shard), ("STEP", step), ("PIECE", piece)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations(1, 120, 3, 30)
    df = spark.createDataFrame([(*r, "p", 1, "n", 2) for r in rows], TURNS).repartition(5)
    got = result(df)
    assert sorted(map(str, got)) == sorted(map(str, plain(rebuilt(rows))))
    assert len({(r[0], r[1]) for r in got}) == len(got)


def test_tries_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(trie, "HEAVY", 5)
    rows = conversations(2, 60, 2, 20)
    df = spark.createDataFrame([(*r, "p", 1, "n", 2) for r in rows], TURNS).repartition(3)
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    assert sorted(map(str, result(df))) == sorted(map(str, con.sql(queries.OP13_SQL).fetchall()))


def test_few_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert result(none) == []
    own = hashlib.sha256(b"3").hexdigest()
    h = zlib.crc32(b"3") % 9
    assert h > 0  # its only turn is replaced by nothing: a conversation without turns
    one = spark.createDataFrame([(3, 0, "user", "x", "p", 1, "n", 2)], TURNS)
    assert result(one) == [(3, 0, None, 1, 0, 1, 0, own)]
    assert result(one.withColumn("conv_id", F.lit(None).cast("long"))) == []


def test_louds_by_rank_and_select():
    #         1        2      3
    #       4   5             6
    parent = np.array([0, 0, 0, 1, 1, 3])
    bits = trie.louds(parent, 7)
    assert "".join(map(str, bits.astype(int))) == "1110110010000"
    assert trie.parents(bits).tolist() == parent.tolist()
    assert trie.child_counts(bits).tolist() == [3, 2, 0, 1, 0, 0, 0]
    got = trie.rolled(bits, np.array([1, 2, 3, 4, 5, 6]), np.array([0, 1, 1, 2, 1, 1]), np.array([9, 5, 4, 8, 2, 1]))
    assert got["n_convs"].tolist() == [3, 1, 2, 2, 1, 1] and got["conv_id"].tolist() == [2, 5, 1, 8, 2, 1]
    assert got["n_leaves"].tolist() == [2, 1, 1, 1, 1, 1] and got["saved"].tolist() == [2 + 4, 0, 3, 4, 0, 0]
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        parent = np.sort([rng.integers(0, k) for k in range(1, n)]).astype(np.int64)
        bits = trie.louds(parent, n)
        assert len(bits) == 2 * n - 1 and (trie.parents(bits) == parent).all()
        assert (trie.read_bits(np.packbits(bits, bitorder="little").tobytes(), n - 1) == bits).all()


def test_built_tries_hold_their_paths():
    rng = random.Random(8)
    name = lambda path: hashlib.blake2b(repr(path).encode(), digest_size=trie.NAME).digest()
    paths = [[rng.randrange(3) for _ in range(rng.randrange(1, 7))] for _ in range(60)]
    named = [[name(p[: k + 1]) for k in range(len(p))] for p in paths]
    bits, names, depths, nodes = trie.built(named, np.full(len(paths), 1))
    up = trie.parents(bits)
    for path, at in zip(named, nodes, strict=True):
        assert [bytes(names[k - 1]) for k in at] == path and depths[at - 1].tolist() == list(range(1, len(path) + 1))
        assert up[at - 1].tolist() == [0, *at[:-1].tolist()]
    assert len(names) == len({x for p in named for x in p}) and (np.diff(depths) >= 0).all()


def test_digests_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 5)
    rows = [(bytes([k % 3]) * 16, k * 37 % 1009 - 100) for k in range(1000)] + [(b"z" * 16, 5)]
    got = {bytes(r.name): bytes(r.ends) for r in trie.ends_of(spark.createDataFrame(rows, "name binary, conv_id long").repartition(7)).collect()}
    by = defaultdict(list)
    for name, c in rows:
        by[name].append(c)
    assert got == {name: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).digest() for name, ids in by.items()}
