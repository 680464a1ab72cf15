"""URL filters: rules on hosts and paths, and for urls that no rule fits a path-template tree.

Paths become templates: segments that are numbers, hashes or dates are classes, and a place in the tree of a host whose
children are many takes its rare ones together as a wildcard. Then sibling branches are merged that are statistically
alike, labelled or not: what follows them is dealt out as under the whole place, by a chi-squared test, and so are the
labels of those that have any. Urls that rules decide are the labels, so a merged branch hands the labels of some siblings
on to the others. A template is rejected if enough labels are under it and its share of blocked ones is high, smoothed
level by level: by its parent's share, and the host's by that of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import spill

#: (verdict, host, path) of the rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEPTH = 4
#: At a place with more distinct children than FAN_OUT those with less than RARE of its urls are one wildcard.
FAN_OUT, RARE = 16, 0.05
#: The normal quantile of the tests: branches differ if chance alone makes such a difference in one case of a thousand.
QUANTILE = 3.0902
#: Labels that a template needs; the weight of the parent's share in smoothing; the smoothed share that rejects.
LEAST, WEIGHT, PURITY = 20, 10, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """A-Z lower-cased; empty if the url is null or has no ://."""
    found = F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(begin)
        rule, verdict = F.when(fits, at + begin).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Array of the classes of a path's first DEPTH segments; what is deeper is one more, `**`."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")

    def kind(s: Column) -> Column:
        form = r"(?s)\A(.*?)(\.[A-Za-z0-9]{1,5})?\z"
        stem, ending = (F.translate(F.regexp_extract(s, form, i), UPPER, LOWER) for i in (1, 2))
        stem = (
            F.when(stem.rlike(r"\A[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z"), "{date}")
            .when(stem.rlike(r"\A[0-9]+\z"), "{n}")
            .when(stem.rlike(r"\A[0-9a-f-]{8,}\z") & stem.rlike("[0-9]"), "{hex}")
            .otherwise(F.regexp_replace(stem, "[0-9]+", "{n}"))
        )
        return F.concat(stem, ending)

    return F.concat(F.transform(F.slice(parts, 1, DEPTH), kind), F.when(F.size(parts) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


def _shape(s: Column) -> Column:
    """A segment's class without its words, of which there may be any number."""
    return F.when(s.rlike(r"\A[{*]"), s).otherwise(F.concat(F.lit("w"), F.regexp_extract(s, r"(\.[a-z0-9]{1,5})?\z", 1)))


def _critical(freedom: Column) -> Column:
    """The chi-squared value at QUANTILE (the approximation of Wilson and Hilferty); zero degrees of freedom: zero."""
    part = 2.0 / (9.0 * freedom)
    return F.when(freedom > 0, freedom * F.pow(1.0 - part + QUANTILE * F.sqrt(part), F.lit(3.0))).otherwise(F.lit(0.0))


def _alike(leaves: DataFrame) -> DataFrame:
    """(host, template, name) of the branches of leaves(host, template, name, rest, n, bad, good) that are merged.

    A branch is compared with all of its place: there are as many names as FAN_OUT and RARE allow, and as many rests as
    shapes, so a place takes few rows, however many urls it has.
    """
    place = ["host", "template"]
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    cells = spill(leaves.where("name <> ''").groupBy(*place, "name", "rest").agg(*sums))
    rests = cells.groupBy(*place, "rest").agg(F.sum("n").alias("of_rest"))
    whole = cells.groupBy(*place).agg(F.sum("n").alias("whole"), F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"), F.countDistinct("rest").alias("rests"))
    parts = cells.join(rests, [*place, "rest"]).withColumn("part", F.col("n") * F.col("n") / F.col("of_rest"))
    kids = parts.groupBy(*place, "name").agg(*sums, F.sum("part").alias("part")).join(whole, place)
    structure = F.col("whole") * F.col("part") / F.col("n") - F.col("n")  # the sum of (seen - expected) ** 2 / expected
    labelled, share = F.col("bad") + F.col("good"), F.col("all_bad") / (F.col("all_bad") + F.col("all_good"))
    apart = F.when((labelled > 0) & (F.col("all_bad") > 0) & (F.col("all_good") > 0), F.pow(F.col("bad") - labelled * share, F.lit(2.0)) / (labelled * share * (1.0 - share))).otherwise(F.lit(0.0))
    like = kids.where((structure <= _critical(F.col("rests") - 1.0) + 1e-9) & (apart <= _critical(F.lit(1.0))))
    several = like.groupBy(*place).agg(F.count("*").alias("likes")).where("likes > 1")
    return spill(like.join(several, place).select(*place, "name", F.lit(True).alias("merged")))


def template_tree(pages: DataFrame) -> DataFrame:
    """(host, segments, template, labelled, purity, rejected) from pages(host, segments, verdict): the leaves of all hosts' trees.

    The urls are combined into distinct class paths first, on the map side; the tree is grown on these, from the host
    down. In a template `*` is the wildcard and `~` a merged branch; one that ends in `/` is all of a path. The end of a
    path is a branch too, but never merged.
    """
    bad, good = (F.count_if(F.col("verdict") == v) for v in ("block", "allow"))
    leaves = spill(pages.groupBy("host", "segments").agg(F.count("*").alias("n"), bad.alias("bad"), good.alias("good")))
    base = leaves.agg(F.coalesce(F.sum("bad") / F.greatest(F.sum("bad") + F.sum("good"), F.lit(1)), F.lit(0.0))).first()[0]  # one number
    leaves = leaves.withColumn("template", F.lit("")).withColumn("purity", F.lit(float(base)))
    for depth in range(DEPTH + 1):
        if depth:
            here = F.coalesce(F.get("segments", F.lit(depth - 1)), F.lit(""))
            rest = F.array_join(F.transform(F.slice("segments", depth + 1, DEPTH), _shape), "/")
            grown = leaves.select("*", here.alias("child"), rest.alias("rest"))
            children = grown.groupBy("host", "template", "child").agg(F.sum("n").alias("n"))
            places = children.groupBy("host", "template").agg(F.count_if(F.col("child") != "").alias("fan"), F.sum("n").alias("all"))
            rare = children.join(places, ["host", "template"]).where((F.col("fan") > FAN_OUT) & (F.col("n") < RARE * F.col("all")) & (F.col("child") != ""))
            wild = spill(rare.select("host", "template", "child", F.lit(True).alias("wild")))
            grown = grown.join(wild, ["host", "template", "child"], "left").withColumn("name", F.when(F.col("wild"), "*").otherwise(F.col("child")))
            grown = spill(grown.drop("child", "wild"))
            grown = grown.join(_alike(grown), ["host", "template", "name"], "left")
            name = F.when(F.col("template").endswith("/"), "").when(F.col("name") == "", "/").when(F.col("merged"), "/~").otherwise(F.concat(F.lit("/"), "name"))
            leaves = grown.withColumn("added", name).withColumn("template", F.concat("template", "added")).drop("name", "rest", "merged")
        else:
            leaves = leaves.withColumn("added", F.lit("host"))
        leaves = spill(leaves)
        nodes = leaves.groupBy("host", "template").agg(F.sum("bad").alias("bads"), (F.sum("bad") + F.sum("good")).alias("labelled"))
        smoothed = (F.col("bads") + WEIGHT * F.col("purity")) / (F.col("labelled") + WEIGHT)
        leaves = leaves.drop("labelled").join(nodes, ["host", "template"]).withColumn("purity", F.when(F.col("added") == "", F.col("purity")).otherwise(smoothed)).drop("bads", "added")
    return leaves.select("host", "segments", "template", "labelled", "purity", ((F.col("labelled") >= LEAST) & (F.col("purity") >= PURITY)).alias("rejected"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict, template) of every row of pages(key, url).

    A null url, or one without ://, has an empty host and path, fits no rule, and is allowed. Of rules that fit the one of
    most characters (host and path) counts; of equally long ones the last listed. template is null for urls that a rule decides and for templates
    that aren't rejected. Long urls are kept whole; of their path the first DEPTH segments make the template. Repeated rows
    and null keys stay and are counted each. Other columns don't matter, whatever their names. An empty table gives none.
    Only rejected templates are joined back to pages. Runs jobs while it is built.
    """
    url = F.col("url").cast("string")
    found = pages.select(F.col(key).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    found = found.select("*", rule.alias("rule"), verdict.alias("verdict"), segments(F.col("path")).alias("segments"))
    tree = template_tree(found.where("host <> ''"))
    rejected = spill(tree.where("rejected").select("host", "segments", "template"))
    decided = found.where("verdict is not null").select("key", "host", "path", "rule", "verdict", F.lit(None).cast("string").alias("template"))
    rest = found.where("verdict is null").join(rejected, ["host", "segments"], "left")
    rest = rest.select("key", "host", "path", "rule", F.when(F.col("template").isNotNull(), "block").otherwise("allow").alias("verdict"), "template")
    return decided.unionByName(rest).withColumnRenamed("key", key)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _rules_sql(kind: bool) -> str:
    listed = sorted(reversed(RULES), key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{begin}') THEN '{verdict if kind else at + begin}'" for verdict, at, begin in listed) + " END"


def _tree_sql(depth: int) -> str:
    """One level of the tree, from t{depth - 1} to t{depth}."""
    d, critical = depth, "{0} * pow(1.0 - 2.0 / (9.0 * {0}) + 3.0902 * sqrt(2.0 / (9.0 * {0})), 3.0)"
    return rf"""
g{d} AS (SELECT *, coalesce(segs[{d}], '') AS child, array_to_string(list_transform(list_slice(segs, {d + 1}, {d + DEPTH}), lambda s: CASE WHEN regexp_matches(s, '^[{{*]') THEN s ELSE 'w' || regexp_extract(s, '(\.[a-z0-9]{{1,5}})?\z', 1) END), '/') AS rest FROM t{d - 1}),
c{d} AS (SELECT host, template, child, sum(n) AS n FROM g{d} GROUP BY ALL),
f{d} AS (SELECT host, template, count(*) FILTER (child <> '') AS fan, sum(n) AS total FROM c{d} GROUP BY ALL),
n{d} AS (SELECT g.*, CASE WHEN fan > {FAN_OUT} AND c.n < {RARE}::DOUBLE * total AND child <> '' THEN '*' ELSE child END AS name FROM g{d} g JOIN c{d} c USING (host, template, child) JOIN f{d} USING (host, template)),
e{d} AS (SELECT host, template, name, rest, sum(n) AS n, sum(bad) AS bad, sum(good) AS good FROM n{d} WHERE name <> '' GROUP BY ALL),
r{d} AS (SELECT host, template, rest, sum(n) AS of_rest FROM e{d} GROUP BY ALL),
w{d} AS (SELECT host, template, sum(n) AS whole, sum(bad) AS all_bad, sum(good) AS all_good, count(DISTINCT rest) - 1.0 AS freedom FROM e{d} GROUP BY ALL),
k{d} AS (SELECT host, template, name, sum(n) AS n, sum(bad) AS bad, sum(good) AS good, sum(n::DOUBLE * n / of_rest) AS part FROM e{d} JOIN r{d} USING (host, template, rest) GROUP BY ALL),
l{d} AS (
  SELECT host, template, name FROM k{d} JOIN w{d} USING (host, template)
  WHERE whole * part / n - n <= CASE WHEN freedom > 0 THEN {critical.format("freedom")} ELSE 0 END + 1e-9
  AND CASE WHEN bad + good > 0 AND all_bad > 0 AND all_good > 0
      THEN pow(bad - (bad + good) * (all_bad / (all_bad + all_good)), 2.0) / ((bad + good) * (all_bad / (all_bad + all_good)) * (1.0 - all_bad / (all_bad + all_good))) ELSE 0 END <= {critical.format("1.0::DOUBLE")}
),
m{d} AS (SELECT host, template, name, true AS merged FROM l{d} WHERE (SELECT count(*) FROM l{d} o WHERE o.host = l{d}.host AND o.template = l{d}.template) > 1),
a{d} AS (
  SELECT n.*, CASE WHEN ends_with(template, '/') THEN '' WHEN name = '' THEN '/' WHEN merged THEN '/~' ELSE '/' || name END AS added
  FROM n{d} n LEFT JOIN m{d} USING (host, template, name)
),
b{d} AS (SELECT host, template || added AS template, segs, n, bad, good, purity, added FROM a{d}),
s{d} AS (SELECT host, template, sum(bad) AS bads, sum(bad) + sum(good) AS labelled FROM b{d} GROUP BY ALL),
t{d} AS (SELECT host, template, segs, n, bad, good, labelled, CASE WHEN added = '' THEN purity ELSE (bads + {WEIGHT} * purity) / (labelled + {WEIGHT}) END AS purity FROM b{d} JOIN s{d} USING (host, template)),"""


OP2_SQL = rf"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), judged AS (
  SELECT *, {_rules_sql(False)} AS rule, {_rules_sql(True)} AS verdict, list_filter(string_split(path, '/'), lambda s: s <> '') AS cut FROM parts
), stems AS (
  SELECT *, list_transform(list_slice(cut, 1, {DEPTH}), lambda s: {{'stem': translate(regexp_extract(s, '(?s)\A(.*?)(\.[A-Za-z0-9]{{1,5}})?\z', 1), '{UPPER}', '{LOWER}'), 'ending': translate(regexp_extract(s, '(?s)\A(.*?)(\.[A-Za-z0-9]{{1,5}})?\z', 2), '{UPPER}', '{LOWER}')}}) AS stems FROM judged
), classes AS (
  SELECT page_id, host, path, rule, verdict, list_transform(stems, lambda x: CASE WHEN regexp_matches(x.stem, '\A[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?\z') THEN '{{date}}' WHEN regexp_matches(x.stem, '\A[0-9]+\z') THEN '{{n}}'
    WHEN regexp_matches(x.stem, '\A[0-9a-f-]{{8,}}\z') AND regexp_matches(x.stem, '[0-9]') THEN '{{hex}}' ELSE regexp_replace(x.stem, '[0-9]+', '{{n}}', 'g') END || x.ending) || CASE WHEN len(cut) > {DEPTH} THEN ['**'] ELSE [] END AS segs FROM stems
), leaves AS (
  SELECT host, segs, count(*) AS n, count(*) FILTER (verdict = 'block') AS bad, count(*) FILTER (verdict = 'allow') AS good FROM classes WHERE host <> '' GROUP BY ALL
), base AS (SELECT coalesce(sum(bad)::DOUBLE / greatest(sum(bad) + sum(good), 1), 0.0) AS base FROM leaves),
h AS (SELECT host, sum(bad) AS bads, sum(bad) + sum(good) AS labelled FROM leaves GROUP BY ALL),
t0 AS (SELECT host, '' AS template, segs, n, bad, good, labelled, (bads + {WEIGHT} * base) / (labelled + {WEIGHT}) AS purity FROM leaves JOIN h USING (host) CROSS JOIN base),
{"".join(_tree_sql(d + 1) for d in range(DEPTH))}
rejected AS (SELECT host, segs, template FROM t{DEPTH} WHERE labelled >= {LEAST} AND purity >= {PURITY}::DOUBLE)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN template IS NULL THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN verdict IS NULL THEN template END AS template
FROM classes LEFT JOIN rejected USING (host, segs)
"""
