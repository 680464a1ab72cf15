"""Merkle manifest of a dataset: each row is a leaf, each group of rows a tree, and the groups' roots a tree of their own.

A level is a window: nodes of a group are partitioned by the index of their parent, and the ordered list of a run's digests,
taken over the full frame, is both what the parent digests and the siblings that a proof needs. One row of each run stays as
the parent, and the next level has a sixteenth of the rows. No window holds more than sixteen.

Places within a group come from a range partitioning and counts per range, so that a group that holds most rows is no task's
alone. Proofs are handed down from the root: a run's path is joined to its members, so only the last join touches all leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spill

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for a null, else how many UTF-8 bytes the value's text has, `:`, and the text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return digest(*map(field, values))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_of(path: Column) -> Column:
    """All siblings on a path in a row."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def ranked(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """nodes(g, ...) with `at`, the place within g by `order` (nulls first), from 0, and `n`, the rows of g.

    Ranges of (g, order) are sorted one by one and numbered as they are written; a range's place in its group follows from
    the counts of the ranges before it, one row per range and group.
    """
    by = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    number = F.monotonically_increasing_id().alias("number")
    table = spill(nodes.repartitionByRange(*by).sortWithinPartitions(*by).select("*", number)).withColumn("part", F.shiftright("number", 33))
    runs = table.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("number").alias("first"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("g", "part", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    return table.join(starts, ["g", "part"]).select(*nodes.columns, (F.col("number") + F.col("shift")).alias("at"), "n")


def levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """leaves(g, at, n, h, ...) and above them the written tables (g, at, n, h, kids) of parents, up to where each g has one."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    up = F.floor(F.col("at") / fan)
    run = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while most > 1:
        kids = out[-1].where("n > 1").select("g", "at", "n", "h", up.alias("up")).withColumn("kids", F.collect_list("h").over(run))
        parents = kids.where(F.col("at") % fan == 0).select("g", F.col("up").alias("at"), F.ceil(F.col("n") / fan).alias("n"), digest(F.array_join("kids", "")).alias("h"), "kids")
        out.append(spill(parents))
        most = -(-most // fan)
    return out


def tops(tree: list[DataFrame]) -> DataFrame:
    """(g, h): what remains of each group."""
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("g", "h") for level in tree])


def with_paths(tree: list[DataFrame], ends: DataFrame, fan: int = FAN) -> DataFrame:
    """The leaves of tree with the columns of ends(g, path, ...): a leaf's path is its siblings, level by level, then its group's."""
    carried = [c for c in ends.columns if c not in ("g", "path")]
    at, found = (F.col("at") % fan).cast("int"), None
    for k in range(len(tree) - 1, -1, -1):
        level = tree[k] if k else tree[0].withColumn("kids", F.lit(None).cast("array<string>"))
        here = level.where("n = 1").join(ends, "g").select(*level.columns, "path", *carried)
        if found is not None:
            above = found.select("g", F.col("at").alias("up"), F.col("kids").alias("run"), F.col("path").alias("rest"), *carried)
            step = F.struct(F.array_join(F.slice("run", F.lit(1), at), "").alias("left"), F.array_join(F.slice("run", at + 2, F.lit(fan)), "").alias("right"))
            below = level.where("n > 1").withColumn("up", F.floor(F.col("at") / fan)).join(above, ["g", "up"])
            here = here.unionByName(below.select(*level.columns, F.concat(F.array(step), "rest").alias("path"), *carried))
        found = here if k == 0 else spill(here)
    return found.drop("kids")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", **extra: Column) -> DataFrame:
    """(order, leaf, subroot, root, path[, extra]) of every row of docs; path: array of (left, right) siblings, leaf to root.

    extra: further columns made of docs' columns. A null field counts as `-`, a null group is a group of its own and comes
    first, a null order comes first. Rows of equal order go by leaf digest, so repeated rows, which are leaves of their own,
    have equal leaves and the places next to each other. Other columns don't matter. An empty table gives none. A very long
    text is digested whole. Runs jobs while it is built; what it writes is digests, not texts.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(F.col(order).alias("key"), name.alias("g"), leaf_of(*map(F.col, fields)).alias("h"), *(c.alias(f"extra_{k}") for k, c in extra.items()))
    tree = levels(ranked(spill(rows), ["key", "h"]))
    trunk = levels(ranked(tops(tree).select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), ["source"]))
    end = tops(trunk).select("g", F.col("h").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    ends = spill(with_paths(trunk, end).select(F.col("source").alias("g"), "path", F.col("h").alias("subroot"), "root"))
    found = with_paths(tree, ends)
    return found.select(F.col("key").alias(order), F.col("h").alias("leaf"), "subroot", "root", "path", *(F.col(f"extra_{k}").alias(k) for k in extra))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.when(chosen, leaf_of(*(F.translate("text", CAPITALS, CAPITALS.lower()) if c == "text" else F.col(c) for c in FIELDS)))
    found = manifest(docs, tampered=lowered).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_of(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(depth: int = 6, height: int = 4) -> str:
    """Trees of up to 16**depth leaves a source and 16**height sources."""
    h = lambda values: f"sha256(concat({', '.join(f'coalesce(strlen(CAST({v} AS VARCHAR)) || chr(58) || {v}, chr(45))' for v in values)}))"
    parts = [
        "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS g, {h(FIELDS)} AS leaf, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 THEN {h([*FIELDS[:-1], f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')"])} END AS tampered FROM documents, crc)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM d)",
    ]

    def up(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}{k + 1} AS (SELECT g, place // 16 AS place, (any_value(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY place)) AS h, list(h ORDER BY place) AS kids FROM {name}{k} WHERE n > 1 GROUP BY g, place // 16)")

    up("a", depth)
    parts.append(f"s AS ({' UNION ALL '.join(f'SELECT g, h FROM a{k} WHERE n = 1' for k in range(depth + 1))})")
    parts.append("b0 AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM s)")
    up("b", height)
    parts.append(f"r AS ({' UNION ALL '.join(f'SELECT h AS root FROM b{k} WHERE n = 1' for k in range(height + 1))})")
    side = lambda t, leaf, k: f"{t}{k + 1}.kids[:({leaf}.place // {16**k}) % 16] AS {t}l{k}, {t}{k + 1}.kids[({leaf}.place // {16**k}) % 16 + 2:] AS {t}r{k}"
    joins = " ".join(f"LEFT JOIN a{k + 1} ON a{k + 1}.g = x.g AND a{k + 1}.place = x.place // {16 ** (k + 1)}" for k in range(depth))
    joins += " JOIN b0 y ON y.name = x.g " + " ".join(f"LEFT JOIN b{k + 1} ON b{k + 1}.place = y.place // {16 ** (k + 1)}" for k in range(height))
    parts.append(f"p AS (SELECT x.doc_id, x.leaf, coalesce(x.tampered, x.leaf) AS f, y.h AS subroot, {', '.join([side('a', 'x', k) for k in range(depth)] + [side('b', 'y', k) for k in range(height)])} FROM a0 x {joins})")
    steps = [f"a{{}}{k}" for k in range(depth)] + [f"b{{}}{k}" for k in range(height)]
    text = lambda c: f"coalesce(array_to_string({c}, ''), '')"
    folded = "f"
    for i, s in enumerate(steps):
        now = f"CASE WHEN {s.format('l')} IS NULL THEN {folded} ELSE sha256({text(s.format('l'))} || {folded} || {text(s.format('r'))}) END"
        parts.append(f"f{i} AS (SELECT *, {now} AS v{i} FROM {f'f{i - 1}' if i else 'p'})")
        folded = f"v{i}"
    proof = " || ".join(text(s.format(x)) for s in steps for x in "lr")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {folded} AS folded_root, {folded} = root AS verified FROM f{len(steps) - 1}, r"


OP13_SQL = _sql()
