"""URL filters: written rules first, then a tree of path templates for each host.

A host's paths make a tree of segments.  Level by level, until no segments are left, those
that very few rows have become a wildcard (which keeps the file extension).  Sibling branches
whose labels do not differ significantly from those of all siblings together are merged
into a wildcard, from the deepest level up.  A template is rejected if its purity, the
share of good labels smoothed towards its host's and the whole table's, is low.

DataFrame functions only; every step is a grouped count or a join, so no host, however
large, is gathered in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, copied, dealt, hot_keys, materialise

WILD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty if it is null or has no ``://``."""
    known = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.when(known, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules``, (verdict, "host/path"), that fits: a struct of ``rule`` and ``verdict``, or null."""
    fits = []
    for verdict, rule in rules:
        own, slash, rest = rule.partition("/")
        at = (host == own) | host.endswith("." + own)
        fit = at & path.startswith(slash + rest) if slash else at
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def path_templates(paths: DataFrame, least: int = 3) -> DataFrame:
    """Adds ``template``, an array of segments, to rows with ``host`` and ``path``, each of which counts ``n`` times.

    A segment stays as it is if at least ``least`` of all have it under its parent.  Under a parent of fewer no
    segment can, so all that follow become wildcards at once.  What all paths under a parent begin with, the common
    beginning of the least and the greatest of them, is taken in one step; so there are as many rounds as branchings
    on a path, however deep it is.  A path that has come to its end is written once and read again at the end.
    """
    wild = lambda x: F.concat(F.lit(WILD), F.regexp_extract(x, r"\.[A-Za-z][A-Za-z0-9]{0,4}$", 0))
    rows = paths.withColumns({"left": F.filter(F.split("path", "/"), lambda x: x != ""), "template": F.array().cast("array<string>")})
    ended, rows = [rows.filter(F.size("left") == 0)], rows.filter(F.size("left") > 0)
    while not rows.isEmpty():
        # parents and their segments are known by 64-bit hashes; a host's paths may all have one
        rows = rows.withColumn("segment", F.get("left", F.lit(0))).withColumns({"parent": F.xxhash64("host", "template"), "child": F.xxhash64("host", "template", "segment")})
        counts = materialise(rows.groupBy("parent", "child").agg(F.sum("n").alias("n"), F.min("left").alias("a"), F.max("left").alias("z")), "url-counts")
        same = F.zip_with("a", "z", lambda x, y: x.eqNullSafe(y))
        shared = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("bigint")) - 1, F.size("a").cast("bigint")).cast("int")
        parents = counts.groupBy("parent").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z")).filter(F.col("n") >= least)
        parents = materialise(parents.select("parent", "n", shared.alias("shared")), "url-parents")
        children = counts.filter(F.col("n") >= least).select("child", "n", F.lit(True).alias("literal"))
        hot, hot_child = (materialise(hot_keys(x, key), "url-hot") for x, key in ((parents, "parent"), (children, "child")))
        rows = dealt(rows, "parent", hot, ["path"]).join(copied(parents.select("parent", "shared"), "parent", hot), ["parent", "piece"], "left").drop("piece")
        rows = dealt(rows, "child", hot_child, ["path"]).join(copied(children.drop("n"), "child", hot_child), ["child", "piece"], "left")
        alone, together = F.col("shared").isNull(), F.col("shared") > 0
        named = F.when(F.col("literal"), F.col("segment")).otherwise(wild(F.col("segment")))
        step = F.when(alone, F.transform("left", wild)).when(together, F.slice("left", F.lit(1), F.greatest("shared", F.lit(1)))).otherwise(F.array(named))
        rows = rows.select(*paths.columns, F.concat("template", step).alias("template"), F.slice("left", F.size(step) + 1, F.greatest(F.size("left"), F.lit(1))).alias("left"))
        rows = materialise(rows, "url-level")
        ended.append(rows.filter(F.size("left") == 0))
        rows = rows.filter(F.size("left") > 0)
    return reduce(DataFrame.unionByName, ended).drop("left")


def _with_branch(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """``rows`` with the ``facts`` of their ``key``, of which very many may have one."""
    hot = materialise(hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key), "url-hot")
    return dealt(rows, key, hot, ["template"]).join(copied(facts, key, hot), [key, "piece"]).drop("piece")


def _branchings(counts: DataFrame) -> list[int]:
    """Levels, from the last up, at which some parent has several segments."""
    at = F.explode(F.sequence(F.lit(1), F.size("template"))).alias("d")
    nodes = counts.filter(F.size("template") > 0).select("host", "template", at).select("d", F.xxhash64("host", F.slice("template", F.lit(1), F.col("d") - 1)).alias("parent"), F.element_at("template", F.col("d")).alias("segment")).distinct()
    several = nodes.groupBy("d", "parent").agg(F.count("*").alias("n")).filter("n > 1")
    return sorted((x["d"] for x in several.select("d").distinct().collect()), reverse=True)


def merged_templates(counts: DataFrame, z: float = 1.96) -> DataFrame:
    """From ``host``, ``template``, ``good``, ``bad``: the same with ``merged``, the template that it becomes.

    At each level, from the last up, a branch joins the wildcard branch of its siblings unless its share of
    good labels lies more than ``z`` standard errors from that of all siblings together.  A branch without
    siblings joins it in any case, so levels at which no parent has several take no round.
    """
    counts = materialise(counts, "url-templates")
    levels = _branchings(counts)
    lone = F.transform("template", lambda x, i: F.when((i + 1).isin(levels) if levels else F.lit(False), x).otherwise(F.lit(WILD)))
    rows = counts.withColumn("merged", lone)
    for d in levels:
        wild = F.when(F.size("merged") >= d, F.concat(F.slice("merged", 1, d - 1), F.array(F.lit(WILD)), F.slice("merged", d + 1, F.greatest(F.size("merged"), F.lit(1))))).otherwise(F.col("merged"))
        rows = rows.withColumn("branch", F.xxhash64("host", "merged"))
        branches = rows.groupBy("branch").agg(F.first("host").alias("host"), F.first("merged").alias("template"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
        branches = materialise(branches.withColumn("merged", F.col("template")).withColumn("wild", wild).withColumn("pool", F.xxhash64("host", "wild")), "url-branches")
        pools = materialise(branches.groupBy("pool").agg(F.sum("g").alias("pg"), F.sum("b").alias("pb")), "url-pools")
        n, p = F.col("g") + F.col("b"), F.try_divide("pg", F.col("pg") + F.col("pb"))
        error = F.sqrt(F.try_divide(p * (1 - p), n))  # null without labels
        apart = F.coalesce((error > 0) & (F.abs(F.try_divide("g", n) - p) > z * error), F.lit(False))
        moved = _with_branch(branches, "pool", pools).select("branch", F.when(apart, F.col("merged")).otherwise(F.col("wild")).alias("to"))
        rows = materialise(_with_branch(rows.drop("merged"), "branch", moved).select("host", "template", "good", "bad", F.col("to").alias("merged")), "url-merge")
    return rows


def judge_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str]] = (), label_id_col: str = "doc_id", good: Column | None = None, strength: float = 5.0, purity: float = 0.5) -> DataFrame:
    """A verdict for every url: that of the longest fitting rule, else of its path template.

    Returns one row per page: the id column, ``host``, ``path``, ``rule``, ``verdict`` ("allow" or "block"),
    ``template`` and ``purity``.  A page's label is that of the document whose number ends its path; ``good`` is
    the condition on ``labels`` for a good one (default: quality 1 and toxic 0).  A template's purity counts
    ``strength`` labels of its host's purity, and that as many of the whole table's; below ``purity`` it is
    rejected.

    Defined cases: a null url, or one without ``://``, has an empty host and path, and is judged with its like;
    a path without labels has its host's purity, a host without labels the table's, a table without labels 1;
    of several labels of a document the worst counts; repeated rows are judged alike; an empty table gives an
    empty result; other columns are not read.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), list(rules)))
    rows = rows.withColumn("number", F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1) as bigint)"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0) if good is None else good
    known = labels.select(F.col(label_id_col).cast("bigint").alias("number"), good.cast("int").alias("is_good")).filter("number is not null and is_good is not null").groupBy("number").agg(F.min("is_good").alias("is_good"))
    rows = materialise(rows.join(known, "number", "left").select("id", "host", "path", "fit", "is_good", F.xxhash64("host", "path").alias("place")), "url-rows")
    # templates are built on distinct paths; pages come back at the end
    paths = rows.groupBy("host", "path").agg(F.first("place").alias("place"), F.count("*").alias("n"), F.count_if(F.col("is_good") == 1).alias("good"), F.count_if(F.col("is_good") == 0).alias("bad"))
    paths = path_templates(materialise(paths, "url-paths"))

    counts = paths.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    merged = merged_templates(counts)
    table = merged.agg(F.sum("good").alias("tg"), F.sum("bad").alias("tb"))  # one row
    hosts = merged.groupBy("host").agg(F.sum("good").alias("hg"), F.sum("bad").alias("hb"))
    base = F.coalesce(F.try_divide("tg", F.col("tg") + F.col("tb")), F.lit(1.0))
    hosts = hosts.crossJoin(F.broadcast(table)).select("host", ((F.col("hg") + strength * base) / (F.col("hg") + F.col("hb") + strength)).alias("host_purity"))
    judged = merged.groupBy("host", "merged").agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).withColumn("template", F.col("merged"))
    judged = _with_branch(judged, "host", materialise(hosts, "url-hosts"))
    judged = judged.select(F.xxhash64("host", "merged").alias("to"), ((F.col("g") + strength * F.col("host_purity")) / (F.col("g") + F.col("b") + strength)).alias("purity"))
    verdicts = _with_branch(merged.select("host", "template", "merged", F.xxhash64("host", "merged").alias("to")), "to", judged)
    # a host and template may have very many paths, and a path very many pages
    verdicts = verdicts.withColumn("branch", F.xxhash64("host", "template")).select("branch", "merged", "purity")
    named = paths.select("place", "n", F.xxhash64("host", "template").alias("branch"))
    hot = materialise(hot_keys(named.groupBy("branch").agg(F.count("*").alias("n")), "branch"), "url-hot")
    named = materialise(dealt(named, "branch", hot, ["place"]).join(copied(verdicts, "branch", hot), ["branch", "piece"]).select("place", "n", "merged", "purity"), "url-verdicts")
    hot = materialise(hot_keys(named, "place"), "url-hot")
    out = dealt(rows, "place", hot, ["id"]).join(copied(named.drop("n"), "place", hot), ["place", "piece"], "left")
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("purity") < purity, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "purity")
