"""Repair of conversation structure by a bidirectional search for the cheapest edits.

A conversation's rows and four states (nothing yet, after system, after user, after assistant) span a graph without cycles;
its arcs are edits: delete, insert, keep, re-role. Minimum costs forward from the start and backward from the end tell which
arcs are tight, that is on a cheapest way; from the start a set of nodes then follows, at each step, the tight arcs of the
least letter. What is found are the cheapest edits whose letters in a row come first.

Rows are sorted by ranges of (conversation, turn), so that a conversation may lie in several ranges. What the graph needs of a
row is one character. A range's part of a conversation is a segment: if there are several, their costs from any state to any
other are combined as matrices, one of sixteen numbers for a segment, and so every segment knows the costs at its two ends.
Segments are then walked on their own. Texts pass by once more, in order, to be edited; they are streamed, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import spill
from .words import portions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INSERTS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FAULTS = ("", "blank", "duplicate", "truncated")
#: A row's character: its role's initial (system, user, assistant, other) times four, and its fault.
CODES = "abcdefghijklmnop"
NEVER = 1 << 40
AT_START, AT_END = [0, NEVER, NEVER, NEVER], [0, NEVER, NEVER, 0]


def _row_arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, state after) of the edits that take a row, by the state before."""
    initial, fault = divmod(code, 4)
    late = TRUNCATED if FAULTS[fault] == "truncated" else 0
    out = []
    for state in STATES:
        arcs = [("D", DELETE, state)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            if initial == 0 and state == START:
                arcs.append(("K", KEEP + late, SYSTEM))
            needed = INSERTS[state]
            if initial == (1 if needed == USER else 2):
                arcs.append(("K", KEEP + late, needed))
            arcs.append(("R", REROLE + late, needed))
        out.append(arcs)
    return out


ARCS = {c: _row_arcs(i) for i, c in enumerate(CODES)}


def _inserted(costs: list[int]) -> list[int]:
    """Costs by state, with what inserting before the next row reaches."""
    user = min(costs[USER], min(costs[s] for s in (START, SYSTEM, ASSISTANT)) + INSERT)
    return [costs[START], costs[SYSTEM], user, min(costs[ASSISTANT], user + INSERT)]


def _insertable(costs: list[int]) -> list[int]:
    """Costs yet to come by state, if inserting is an option."""
    user = min(costs[USER], costs[ASSISTANT] + INSERT)
    return [min(costs[s], user + INSERT) if INSERTS[s] == USER else user for s in STATES]


def forward(codes: str, entry: list[int]) -> list[list[int]]:
    """Least costs of reaching each state before each row, and after the last."""
    out = [_inserted(entry)]
    for c in codes:
        now, after = out[-1], [NEVER] * 4
        for state, arcs in enumerate(ARCS[c]):
            for _, cost, to in arcs:
                after[to] = min(after[to], now[state] + cost)
        out.append(_inserted(after))
    return out


def backward(codes: str, end: list[int]) -> list[list[int]]:
    """Least costs from each state before each row to the end."""
    out = [_insertable(end)]
    for c in reversed(codes):
        after = out[-1]
        out.append(_insertable([min(cost + after[to] for _, cost, to in arcs) for arcs in ARCS[c]]))
    return out[::-1]


def walk(codes: str, start: int, entry: list[int], end: list[int], last: bool) -> tuple[str, int]:
    """The letters of a segment's edits from a state on a cheapest way, and the state after; only the last inserts at its end."""
    ahead, behind = forward(codes, entry), backward(codes, end)
    least = min(a + b for a, b in zip(ahead[0], behind[0]))
    at, nodes, letters = 0, {start}, []
    while True:
        tight = []
        for state in nodes:
            if at < len(codes):
                tight += [(letter, at + 1, to) for letter, cost, to in ARCS[codes[at]][state] if ahead[at][state] + cost + behind[at + 1][to] == least]
            if (at < len(codes) or last) and ahead[at][state] + INSERT + behind[at][INSERTS[state]] == least:
                tight.append(("I", at, INSERTS[state]))
        if not tight:
            return "".join(letters), min(nodes)
        letters.append(min(tight)[0])
        at = next(to for letter, to, _ in tight if letter == letters[-1])
        nodes = {state for letter, _, state in tight if letter == letters[-1]}


@F.pandas_udf(T.ArrayType(T.LongType()))
def _matrix(codes: pd.Series) -> pd.Series:
    """Least costs from each state before a segment to each after it, inserts at both ends included."""
    return pd.Series([[x for s in STATES for x in forward(c, [0 if t == s else NEVER for t in STATES])[-1]] for c in codes])


def _combine(segments: pd.DataFrame) -> pd.DataFrame:
    """Costs at both ends of each segment of one conversation, from its matrices."""
    s = segments.sort_values("part").reset_index(drop=True)
    steps = [[list(m[4 * i : 4 * i + 4]) for i in STATES] for m in s.matrix]
    entries, ends = [AT_START], [AT_END]
    for m in steps[:-1]:
        entries.append([min(NEVER, *(entries[-1][i] + m[i][j] for i in STATES)) for j in STATES])
    for m in reversed(steps[1:]):
        ends.append([min(NEVER, *(m[i][j] + ends[-1][j] for j in STATES)) for i in STATES])
    return pd.DataFrame({"conv": s.conv, "part": s.part, "entry": entries, "end": ends[::-1], "last": [i == len(s) - 1 for i in range(len(s))]})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _afters(codes: pd.Series, entry: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
    """The state after a segment, by the state before it; -1 for states that no cheapest way passes."""
    out = []
    for c, a, b, z in zip(codes, entry, end, last):
        a, b = list(map(int, a)), list(map(int, b))
        ahead, behind = forward(c, a)[0], backward(c, b)[0]
        least = min(x + y for x, y in zip(ahead, behind))
        out.append([walk(c, s, a, b, z)[1] if a[s] + behind[s] == least else -1 for s in STATES])
    return pd.Series(out)


def _starts(segments: pd.DataFrame) -> pd.DataFrame:
    """The state before each segment of one conversation."""
    s = segments.sort_values("part").reset_index(drop=True)
    starts = [START]
    for after in s.afters:
        starts.append(int(after[starts[-1]]))
    return s.assign(start=starts[:-1])[["conv", "part", "start"]]


@F.pandas_udf(T.StringType())
def _letters(codes: pd.Series, start: pd.Series, entry: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([walk(c, int(s), list(map(int, a)), list(map(int, b)), bool(z))[0] for c, s, a, b, z in zip(codes, start, entry, end, last)], dtype=object)


EDITS = "conv_id {0}, place long, turn long, edit string, role string, text string, fault string, illegal boolean, cost int"
LEGAL = {"su", "ua", "au"}


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each segment's letters and codes before them, to edited rows. Inserts follow the row before, or come first."""
    conv, place, state, role_before, letters, codes, ends = object(), 0, START, None, "", "", False
    at = row_at = 0
    for batch in portions(batches, "text", 8 << 20):
        ids, out = batch.column("conv_id"), []
        taken = []

        def insert(i: int) -> None:
            nonlocal at, place, state
            while at < len(letters) and letters[at] == "I":
                state = INSERTS[state]
                out.append((place, None, "I", "user" if state == USER else "assistant", "", None, False, INSERT))
                taken.append(i)
                at, place = at + 1, place + 1

        columns = [batch.column(c).to_pylist() for c in ("conv", "number", "turn", "role", "text", "codes", "letters")]
        for i, (key, number, turn, role, text, now_codes, now_letters) in enumerate(zip(*columns)):
            if key != conv:
                conv, place, state, role_before = key, 0, START, None
            if number < 0:  # a segment begins
                letters, codes, at, row_at = now_letters, now_codes, 0, 0
                insert(i)
                continue
            letter, fault = letters[at], CODES.index(codes[row_at]) % 4
            illegal = role_before is not None and role_before[:1] + role[:1] not in LEGAL
            role_before = role
            cost = {"D": DELETE, "K": KEEP, "R": REROLE}[letter] + (TRUNCATED if letter != "D" and FAULTS[fault] == "truncated" else 0)
            if letter != "D":
                state = SYSTEM if letter == "K" and state == START and role[:1] == "s" else INSERTS[state]
                role = role if letter == "K" else "user" if state == USER else "assistant"
            out.append((place, turn, letter, role, text, FAULTS[fault] or None, illegal, cost))
            taken.append(i)
            at, row_at, place = at + 1, row_at + 1, place + 1
            insert(i)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
        fields = zip(*out) if out else [()] * len(kinds)
        made = [pa.array(list(v), k) for v, k in zip(fields, kinds)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(taken, pa.int64())), *made], ["conv_id", "place", "turn", "edit", "role", "text", "fault", "illegal", "cost"])


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, edit, role, text, fault, illegal, cost): every edited row of conversations(conv_id, turn, role, text).

    edit: D, I, K or R; rows other than D in order of place are the repaired conversation. turn is null for inserts; role and
    text are those after the edit, a deleted row's its own. illegal: the row doesn't fit the one before it, as they came.
    Rows go by turn (nulls first), then role, then text; rows alike in all are duplicates. A null role or text is one space,
    a null conv_id a conversation of its own. Extra columns don't matter. An empty table gives none. A conversation may lie
    in any number of tasks until its rows are edited, which one task does as they stream by. The partitions of what is
    returned hold whole conversations in order of place. Runs jobs while it is built.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role"), text_of("text"))
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    by = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role")]
    ranged = rows.repartitionByRange(*by, F.left("text", F.lit(64))).sortWithinPartitions(*by, "text")  # rows alike in all of these share a range
    table = spill(ranged.select("*", initial.alias("initial"), fault.alias("fault"), F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("number")))
    part = F.shiftright("number", 33).alias("part")
    seen = table.groupBy("conv", "role", "digest").agg(F.min("number").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    coded = table.select("conv", "role", "digest", "number", part, "initial", "fault").join(seen, ["conv", "role", "digest"], "left")
    # A blank row is blank first, and one seen before is a duplicate before it is truncated.
    coded = coded.withColumn("fault", F.when((F.col("fault") != 1) & (F.col("number") > F.col("earliest")), 2).otherwise(F.col("fault")))
    code = F.substr(F.lit(CODES), F.col("initial") * 4 + F.col("fault") + 1, F.lit(1))
    listed = coded.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("number", code.alias("code")))).alias("codes"))
    segments = spill(listed.select("conv", "part", F.array_join(F.transform("codes", lambda c: c["code"]), "").alias("codes")))

    # Two neighbouring ranges share one conversation at most, so these are few: two segments for each range.
    several = segments.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    cut = spill(segments.join(F.broadcast(several), "conv"))
    costs = cut.select("conv", "part", _matrix("codes").alias("matrix")).groupBy("conv").applyInPandas(_combine, "conv string, part long, entry array<bigint>, end array<bigint>, last boolean")
    costs = spill(costs)
    afters = cut.join(costs, ["conv", "part"]).select("conv", "part", _afters("codes", "entry", "end", "last").alias("afters"))
    starts = afters.groupBy("conv").applyInPandas(_starts, "conv string, part long, start int")
    known = spill(costs.join(starts, ["conv", "part"]))
    of = lambda c, otherwise: F.coalesce(c, otherwise)
    numbers = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    walked = segments.join(F.broadcast(known), ["conv", "part"], "left").select(
        "conv", "part", "codes", _letters("codes", of("start", F.lit(START)), of("entry", numbers(AT_START)), of("end", numbers(AT_END)), of("last", F.lit(True))).alias("letters")
    )
    heads = walked.select("conv", "part", F.lit(-1).cast("long").alias("number"), "codes", "letters")
    stream = table.select("conv", part, "number", "conv_id", "turn", "role", "text").unionByName(heads, allowMissingColumns=True)
    # Inserts before a segment's first row take its conv_id from the head, so that it has to be there.
    stream = stream.withColumn("conv_id", F.when(F.col("number") < 0, F.when(F.col("conv") != "", F.substr("conv", F.lit(2)))).otherwise(F.col("conv_id").cast("string")).cast(kind))
    stream = stream.repartition("conv").sortWithinPartitions("conv", "part", "number")
    return stream.mapInArrow(_edit, EDITS.format(kind))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, of edited rows in order."""
    now = None

    def row() -> tuple:
        turns = now["turns"]
        gaps = now["last"] - now["first"] + 1 - turns if turns else 0
        return now["id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], now["cost"], "".join(now["audit"]), now["hash"].hexdigest()

    kinds = None
    for batch in batches:
        kinds = kinds or [batch.column("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
        out = []
        for conv, place, turn, edit, role, text, fault, illegal, cost in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "turn", "edit", "role", "text", "fault", "illegal", "cost"))):
            if place == 0:
                if now:
                    out.append(row())
                now = {"id": conv, "first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "kept": 0}
            now["audit"].append(edit)
            now["cost"] += cost
            now["illegal"] += illegal
            if fault:
                now[fault] += 1
            if turn is not None and turn != now["last"]:
                now["first"], now["last"], now["turns"] = turn if now["first"] is None else now["first"], turn, now["turns"] + 1
            if edit != "D":
                now["hash"].update(f"{chr(10) if now['kept'] else ''}{role}:{text}".encode())
                now["kept"] += 1
        if out:
            yield _batch(out, kinds)
    if now:
        yield _batch([row()], kinds)


SUMS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)], list(SUMS))


def summed(edits: DataFrame) -> DataFrame:
    """SUMS of each conversation of what repair() returns, taken as it is; its rows in order are what the hash needs."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    return edits.mapInArrow(_sums, f"conv_id {kind}, {', '.join(f'{c} long' for c in SUMS[1:7])}, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Some rows dropped, emptied, without sentence ends, repeated or given to the user, by a checksum of conversation and turn."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by: Column = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    role, text = F.when(by == 4, F.lit("user")).otherwise(text_of("role")), F.when(by == 1, F.lit("")).when(by == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    copies = F.explode(F.when(by == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return conversations.where(by != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def op11_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = summed(repair(damage(turns))).withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMS[1:7]]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """Costs and letters of each state as one text that sorts by both, row by row; letters are replayed for the texts."""
    add = lambda s, cost, letter: f"lpad(CAST(CAST(left({s}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || '{letter}'"
    late, free = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"
    open_ = "least(z, s, a)"
    return rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  told AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
  dealt AS (SELECT told.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM told, crc),
  turns AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM dealt WHERE kind <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM turns),
  judged AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
  steps AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, '000000003I' AS u, '000000006II' AS a FROM (SELECT DISTINCT conv_id FROM judged)
    UNION ALL
    SELECT conv_id, i, z, s, u, least(a, {add("u", 3, "I")}) FROM (SELECT conv_id, i, z, s, least(u, {add(open_, 3, "I")}) AS u, a FROM (
      SELECT p.conv_id, r.i, {add("z", 4, "D")} AS z, least({add("s", 4, "D")}, CASE WHEN {free} AND initial = 's' THEN {add("z", late, "K")} END) AS s,
        least({add("u", 4, "D")}, CASE WHEN {free} AND initial = 'u' THEN {add(open_, late, "K")} END, CASE WHEN {free} THEN {add(open_, f"3 + {late}", "R")} END) AS u,
        least({add("a", 4, "D")}, CASE WHEN {free} AND initial = 'a' THEN {add("u", late, "K")} END, CASE WHEN {free} THEN {add("u", f"3 + {late}", "R")} END) AS a
      FROM steps p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
  best AS (SELECT conv_id, CAST(left(w, 9) AS BIGINT) AS cost, substr(w, 10) AS audit FROM (SELECT conv_id, least(arg_max(z, i), arg_max(a, i)) AS w FROM steps GROUP BY conv_id)),
  letters AS (SELECT conv_id, p, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER o AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER o AS j
    FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS p FROM best WHERE audit <> '') WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
  told_again AS (SELECT l.*, role, text, max(CASE WHEN letter = 'K' AND j = 1 AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system FROM letters l LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D'),
  repaired AS (SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (j - system) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE WHEN letter = 'R' THEN text ELSE '' END END, chr(10) ORDER BY p)) AS h FROM told_again GROUP BY conv_id),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
  SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""


OP11_SQL = _sql()
