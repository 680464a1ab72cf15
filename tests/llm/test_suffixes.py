"""Substring dedup by suffixes against a plain version, with buckets and tasks so small that boundaries matter."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import oracle
import pytest

from larder.llm import suffixes

SCHEMA = "doc_id long, text string, start string, check int"


def plain(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    least = defaultdict(set)
    for i, b in data:
        if i is not None:
            for k in range(len(b) - 49):
                least[b[k : k + 50]].add(i)
    least = {s: min(ids) for s, ids in least.items()}
    out = []
    for i, b in data:
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and least[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def documents(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(k) for k in (8, 9, 10, 12, 60, 200)] + ["=" * 70, "ab" * 40, " ".join(["x"] * 60)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(text(rng.randint(0, 30)))
            parts.append(rng.choice(shared))
        rows.append((i * 3 - 50, " ".join(parts)))
    for _ in range(n // 3):  # copies and near copies
        t = rng.choice(rows)[1].split(" ")
        if len(t) > 4 and rng.random() < 0.7:
            t[rng.randrange(len(t))] = word()
        rows.append((rng.randrange(-100, 500), " ".join(t)))
    return [*rows, (1, None), (2, ""), (None, shared[5]), (None, None), (7, "y" * 49), (8, "y" * 50), (9, "y" * 51), rows[0], rows[0], rows[1], (rows[1][0], rows[2][1])]


@pytest.mark.parametrize("bucket, flush", [(1 << 20, 1 << 20), (40, 25), (300, 1)])
def test_plain(spark, monkeypatch, bucket, flush):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    monkeypatch.setattr(suffixes, "FLUSH", flush)
    rows = documents(bucket)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = suffixes.dedup_suffixes(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == plain(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_cut_texts(monkeypatch):
    """Texts longer than a portion are cut, and each window is in one piece."""
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "PORTION", 64)
    text = bytes(random.Random(1).choices(range(97, 123), k=1000))
    seen = []
    for rows, offsets, pieces in suffixes._pieces(pa.array([text, b"", b"z" * 50], pa.large_binary())):
        s = suffixes.Suffixes(pieces)
        seen += [(rows[p], offsets[p] + a + k) for p, a, n in zip(s.piece, s.start, s.size) for k in range(n)]
    assert sorted(seen) == [*((0, i) for i in range(951)), (2, 0)]


def test_multikey(monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 9)
    rng = np.random.default_rng(2)
    tokens = [rng.integers(0, 12, 3000).astype(np.uint64), rng.integers(0, 5, 3000).astype(np.uint64), rng.integers(-9, 9, 3000)]
    order = suffixes.multikey(tokens)
    assert sorted(zip(*tokens)) == [tuple(t[i] for t in tokens) for i in order]


def test_blocks():
    rng = np.random.default_rng(3)
    first = np.sort(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    r = (rng.integers(-5, 5, 500), rng.integers(-3, 3, 500).astype(np.int32), rng.integers(0, 1 << 33, 500), rng.integers(1, 32, 500), first, rng.integers(0, 1 << 48, 500).astype(np.uint64))
    assert all((a == b).all() for a, b in zip(suffixes._unpack(suffixes._pack(r)), r))


def test_small_tables(spark):
    for rows in ([], [(1, None, "x", 1)], [(1, "q" * 60, "x", 1)]):
        got = suffixes.dedup_suffixes(spark.createDataFrame(rows, SCHEMA)).collect()
        assert [r["n_removed"] for r in got] == [0] * len(rows)


def test_sql(spark, small):
    assert oracle.differences(suffixes.op12_suffixes(spark, small), oracle.connect(small), suffixes.OP12_SQL) is None


def test_memory(monkeypatch):
    """A suffix has 33 bytes; a task holds 65 for each while it packs and 52 while it settles them (77 and 74 before), and sends small batches."""
    import tracemalloc

    import pandas  # noqa: F401  pyarrow loads it when it is first needed
    import pyarrow as pa

    n, rng = 1 << 18, np.random.default_rng(4)
    monkeypatch.setattr(suffixes, "FLUSH", n)

    def make(_):
        for _ in range(16):
            m = n // 16
            yield rng.integers(0, 999, m), np.zeros(m, np.int32), rng.integers(0, 9999, m), rng.integers(1, 32, m), rng.integers(0, 1 << 63, m).astype(np.uint64), rng.integers(0, 1 << 48, m).astype(np.uint64)

    splitters = np.sort(rng.integers(0, 1 << 63, 9).astype(np.uint64))
    tracemalloc.start()
    try:
        sent = []
        for batch in suffixes._blocks(make, splitters, np.zeros(9, np.uint64), 10)(iter(())):
            sent.append(batch)
            assert batch.nbytes < 2 * suffixes.SENT
        packing = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for _ in suffixes._settled(splitters, True)((pa.scalar(0),), iter(sent)):
            pass
        settling = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert packing < 70 * n and settling < 62 * n


def test_few_long_documents(spark, monkeypatch):
    """Where hardly any document is sampled, suffixes are still dealt into buckets; all went to one before."""
    monkeypatch.setattr(suffixes, "BUCKET", 10000)
    found = []
    made = suffixes._blocks
    monkeypatch.setattr(suffixes, "_blocks", lambda make, splitters, *rest: found.append(splitters) or made(make, splitters, *rest))
    rng = random.Random(6)
    rows = [(i, "".join(rng.choices("abcdefgh ", k=400000)), "x", 1) for i in range(3)]
    suffixes.dedup_suffixes(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    edges = np.concatenate([[0.0], found[0].astype(float), [2.0**64]])
    assert len(found[0]) == 7 and np.diff(edges).max() < 2.0**64 / 4
