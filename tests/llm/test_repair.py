"""Conversation repair against a plain search over all cheapest edits, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from larder.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, number int, conv string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        k, role, text = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20, show(role), show(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows):
    """One row per conversation, by a search over (cost, letters) of every state."""
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            solid = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {"0": (0, "", ())}

        def inserted(best):
            for _ in range(3):
                for s, to, role in (("0", "u", "user"), ("s", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
                    if s in best:
                        cost, letters, kept = best[s]
                        best[to] = min(best.get(to, (1 << 40,)), (cost + 3, letters + "I", (*kept, f"{role}:")))
            return best

        for (_, role, text), fault in zip(turns, faults):
            after = {}
            for s, (cost, letters, kept) in inserted(best).items():
                options = [("D", 4, s, kept)]
                if fault not in ("blank", "duplicate"):
                    more, need = 3 * (fault == "truncated"), "a" if s == "u" else "u"
                    if role[:1] == "s" and s == "0":
                        options.append(("K", more, "s", (*kept, f"{role}:{text}")))
                    if role[:1] == need:
                        options.append(("K", more, need, (*kept, f"{role}:{text}")))
                    options.append(("R", 3 + more, need, (*kept, f"{'user' if need == 'u' else 'assistant'}:{text}")))
                for letter, more, to, now in options:
                    after[to] = min(after.get(to, (1 << 40,)), (cost + more, letters + letter, now))
            best = after
        best = inserted(best)
        cost, letters, kept = min(best[s] for s in ("0", "a") if s in best)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def run(spark, rows, path, n=5):
    spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(n).write.parquet(f"{path}/conversations.parquet")
    got = repair.op11_repair(spark, str(path)).collect()
    return {r["conv_id"]: tuple(r)[1:] for r in got}, len(got)


def test_registered(spark, small):
    turns = pd.read_parquet(f"{small}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op11_repair(spark, small).collect()}
    assert got == plain(list(zip(turns.conv_id, turns.turn, turns.role, turns.text)))


@pytest.mark.parametrize("parts", [3, 40])
def test_plain(spark, tmp_path, parts):
    """Small conversations of odd rows, and one that is most of the table, in many ranges."""
    rng, rows = random.Random(parts), []
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "uncle"], ["Yes.", "no", " ", "", None, "What? ", "a.\n", "x" * 3000 + "!", "é\x0b", ".\x85"]
    for conv in [None, *range(60)]:
        rows += [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 9))]
    rows += [(99, i // 2, rng.choice(roles[:3]), f"{rng.choice(texts)} {rng.randint(0, 300)}{rng.choice('.? ')}") for i in range(1500)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, n = run(spark, rows, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == len(got) and got == plain(rows)


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == ({}, 0)
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got, _ = run(spark, [(dropped, 0, "user", "x.")], tmp_path / "one")
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_segments_agree():
    """A conversation cut anywhere gets the edits it gets whole."""
    rng = random.Random(5)
    for _ in range(200):
        codes = "".join(rng.choices(repair.CODES, k=rng.randint(0, 12)))
        cut = sorted(rng.choices(range(len(codes) + 1), k=2))
        pieces = [codes[: cut[0]], codes[cut[0] : cut[1]], codes[cut[1] :]]
        table = pd.DataFrame({"conv": "c", "part": range(3), "codes": pieces})
        table["matrix"] = repair._matrix.func(table.codes)
        ends = repair._combine(table)
        table = table.merge(ends, on=["conv", "part"])
        table["afters"] = repair._afters.func(table.codes, table.entry, table.end, table["last"])
        table = table.merge(repair._starts(table), on=["conv", "part"])
        assert "".join(repair._letters.func(table.codes, table.start, table.entry, table.end, table["last"])) == repair.walk(codes, repair.START, repair.AT_START, repair.AT_END, True)[0]


def test_operator(spark):
    """The repaired rows themselves."""
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "user", "So?"), (1, 3, "user", "So?")]
    got = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("place").collect()
    want = [("I", "user", "", None), ("K", "assistant", "Hi.", None), ("K", "user", "So?", None), ("D", "user", "So?", "duplicate"), ("I", "assistant", "", None)]
    assert [(r["edit"], r["role"], r["text"], r["fault"]) for r in got] == want and sum(r["cost"] for r in got) == 10
