"""Storing facts: one that is near a stored fact counts as a serve of that one, else it is stored itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import signs
from larder.storage import spill

NEAR = 0.95
#: Facts in the first batch; each later one has seven times as many as all before it.
FIRST = 4096


def _leaders(pairs: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """(ord) of those nodes(ord) that no other chosen one of pairs(ord, other) precedes.

    A node is chosen once all it is near to and that come before it are known to be out, and out once one of them is
    chosen. A round settles all nodes for which this is known, at least the first of each group.
    """
    chosen = spill(nodes.select("ord").join(pairs.select("ord").distinct(), "ord", "left_anti"))
    open_ = pairs
    for _ in range(rounds):
        if open_.isEmpty():
            return chosen
        out = spill(open_.join(chosen.select(F.col("ord").alias("other")), "other", "left_semi").select("ord").distinct())
        left = open_.join(out, "ord", "left_anti")
        waiting = spill(left.join(out.select(F.col("ord").alias("other")), "other", "left_anti").select("ord", "other"))
        free = left.select("ord").distinct().join(waiting.select("ord").distinct(), "ord", "left_anti")
        chosen, open_ = spill(chosen.unionByName(free)), waiting
    raise RuntimeError(f"facts depend on each other over more than {rounds} rounds")


def _near(left: DataFrame, right: DataFrame | None, near: float) -> DataFrame:
    """(ord, other, similarity) of signed vectors; of left alone those that come before."""
    return spill(signs.near_pairs(left, right, near).select(F.col("query_id").alias("ord"), F.col("id").alias("other"), "similarity"))


def merged(facts: DataFrame, near: float = NEAR, cells_of: int = 64, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """What storing facts(fact_id, ord, text, vector) one after another leaves, in order of ord: (stored, merges).

    stored(fact_id, serve_count): facts that had none stored before them nearer than `near`, by cosine; each other one is
    a serve of the nearest stored before it, of equally near ones of the first. merges(fact_id, into): these.
    Facts of one text have one vector and count as one until the end, so that a common fact isn't paired with itself.
    Batches grow eightfold: a batch is first joined with what is stored, and only what is near nothing there is paired with its
    like, so that of a large group of similar facts only the first batch that holds it has pairs of its own. Within a batch
    facts are settled in rounds; more than `rounds` raise an error, nothing is left out. ord is unique. Facts without
    vector or direction are near nothing but the same text. An empty table gives none.
    cells_of is taken for older callers and has no effect. Runs jobs.
    """
    same = F.coalesce(F.sha2("text", 256), F.lit(""))
    rows = spill(facts.select("fact_id", F.col("ord").cast("long").alias("ord"), same.alias("same"), "vector"))
    nodes = spill(rows.groupBy("same").agg(F.min(F.struct("ord", "fact_id")).alias("first")).select("same", "first.*"))
    n, sizes = nodes.count(), [FIRST]
    while sizes[-1] < n:
        sizes.append(8 * sizes[-1])
    ends = nodes.agg(F.percentile_approx("ord", [min(1.0, x / max(n, 1)) for x in sizes], 100_000)).first()[0] or []
    signed = signs.signed(rows.join(nodes.select("ord"), "ord", "left_semi").select(F.col("ord").alias("id"), "vector"), near)
    chosen, stored, low = spill(nodes.select("ord").join(signed.select(F.col("id").alias("ord")), "ord", "left_anti")), None, None
    for end in [*ends[:-1], None]:
        batch = signed.where((F.lit(True) if low is None else F.col("id") > low) & (F.lit(True) if end is None else F.col("id") <= end))
        if stored is not None:
            batch = spill(batch.join(_near(batch, stored, near).select(F.col("ord").alias("id")).distinct(), "id", "left_anti"))
        before = _near(batch, None, near).select("ord", "other")
        leaders = _leaders(before, batch.select(F.col("id").alias("ord")), rounds)
        new = spill(batch.join(leaders.select(F.col("ord").alias("id")), "id", "left_semi"))
        chosen, stored, low = chosen.unionByName(leaders), new if stored is None else stored.unionByName(new), end
    # What is stored has none stored before it, and its copies are nearest to itself.
    to = _near(signed.join(chosen.select(F.col("ord").alias("id")), "id", "left_anti"), stored, near).withColumnRenamed("ord", "node")
    stored = chosen
    # A later fact of a text may have other stored facts before it than the first one had.
    each = rows.join(nodes.select("same", F.col("ord").alias("node")), "same")
    options = each.join(to, "node").where("other < ord").select("fact_id", "ord", "other", "similarity")
    own = each.join(stored.select(F.col("ord").alias("node")), "node", "left_semi").where("node < ord").select("fact_id", "ord", F.col("node").alias("other"), F.lit(1.0).alias("similarity"))
    best = options.unionByName(own).groupBy("fact_id", "ord").agg(F.max_by("other", F.struct("similarity", -F.col("other"))).alias("other"))
    ids = nodes.select(F.col("ord").alias("other"), F.col("fact_id").alias("into"))
    merges = spill(best.join(stored.select("ord"), "ord", "left_anti").join(ids, "other").select("fact_id", "into"))
    serves = merges.groupBy(F.col("into").alias("fact_id")).agg(F.count("*").alias("n"))
    kept = nodes.join(stored.select("ord"), "ord", "left_semi").join(serves, "fact_id", "left")
    return kept.select("fact_id", F.coalesce("n", F.lit(0)).alias("serve_count")), merges
