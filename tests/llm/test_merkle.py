"""The Merkle manifest against a plain version, and its edge cases."""

import hashlib
import zlib
from collections import defaultdict

import oracle
import pytest

from larder.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def tree(nodes):
    """The root of a list of digests, and each one's path of (left, right)."""
    paths, members, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [range(i, min(i + 16, len(level))) for i in range(0, len(level), 16)]
        for run in runs:
            for i in run:
                for m in members[i]:
                    paths[m].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        members = [[m for i in run for m in members[i]] for run in runs]
        level = [digest(*(level[i] for i in run)) for run in runs]
    return level[0], paths


def plain(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: (x := sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))), *tree([leaf(r) for r in x])) for s in order}
    root, upper = tree([made[s][1] for s in order])
    for s, above in zip(order, upper):
        members, subroot, paths = made[s]
        for r, path in zip(members, paths):
            tampered = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                tampered = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node = leaf(tampered)
            for left, right in path + above:
                node = digest(left, node, right)
            out.append((r[0], leaf(r), subroot, root, digest(*(x for step in path + above for x in step)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [1, 3, 40])
def test_plain(spark, tmp_path, groups):
    rows = [(i * 7 - 300, None if i % groups == 1 else f"s{i % groups}é", None if i % 5 == 0 else "en", None if i % 3 == 0 else i, None if i % 11 == 0 else f"Text Ä {i}", "x", 1) for i in range(300)]
    rows += [(5000 + i, "big", "de", 1, f"B{i}", "x", 2) for i in range(700)]
    rows += [rows[3], rows[3], (None, "big", None, None, "N", "x", 1), (1, "big", "en", 2, "A" * 300_000, "x", 1), (1, "big", "en", 2, "", "x", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in merkle.op13_merkle(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)


def test_small(spark, tmp_path):
    for rows in ([], [(1, None, None, None, None, "x", 1)], [(1, "a", "en", 1, "X", "x", 1), (2, "b", "en", 1, "Y", "x", 1)]):
        folder = tmp_path / str(len(rows))
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        got = [tuple(r) for r in merkle.op13_merkle(spark, str(folder)).collect()]
        assert sorted(got, key=str) == (plain(rows) if rows else [])


def test_tampering_shows(spark, small):
    got = merkle.op13_merkle(spark, small).collect()
    assert not all(r["verified"] for r in got) and all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
    assert len({r["root"] for r in got}) == 1


def test_sql(spark, small):
    assert oracle.differences(merkle.op13_merkle(spark, small), oracle.connect(small), merkle.OP13_SQL) is None
