"""URL filtering by rules and by a tree of path templates with smoothed label purity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.staging import staged

# The rules of the registered query, (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Settings:
    """variable_kinds: from so many distinct children a branch's segments are variable. merge_gap, merge_z: sibling templates whose purities differ by less
    than the gap, or by fewer standard errors of their counts, are merged. prior: pseudo-counts that a parent lends its
    children. reject: a template of a lower purity is blocked. broadcast: characters of the branches or verdicts that are
    known everywhere at most."""

    variable_kinds: int = 20
    merge_gap: float = 0.1
    merge_z: float = 2.0
    prior: float = 5.0
    reject: float = 0.5
    broadcast: int = 16_000_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. The list is a parameter that the plan holds as literals."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fit = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        fits = F.when(fit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labels: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row of pages (page_id, url).

    A rule decides where one fits. The labels (url, good 0/1; by default the decided urls, good where allowed) are counted
    in a tree of templates: a segment with a digit is *; per host, level by level, the segments of a branch with many
    distinct ones become * too; sibling branches with alike smoothed purities are merged into one; a template's purity is
    smoothed by the same template over all hosts (a merged one by its members' labels over all hosts), and that by the
    whole. Every segment has a level, however long the path; levels where no host has siblings take no job. Templates under settings.reject are blocked, others allowed.

    Null urls and urls without :// have an empty host and path and go by the empty template; repeated rows are judged
    each; an empty table gives no rows; other columns are ignored. The tree is grown on one row a host and shape (path
    with its digits as *), each level read once; urls meet it only in the end, by their shape. Every count is a partial
    aggregate before its shuffle. Branches and verdicts are broadcast up to settings.broadcast characters; beyond that they are
    joined by shuffle, with hot hosts split by the join's skew handling.
    """
    s = settings
    url = F.col("url").cast("string")
    base = pages.select(F.col("page_id"), url.alias("url")).select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    base = base.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    seen = base.select("host", "shape", F.when(F.col("hit").isNotNull(), (F.col("hit.verdict") == "allow").cast("int")).alias("good"))
    if labels is not None:
        lab = F.col("url").cast("string")
        told = labels.select(host_of(lab).alias("host"), shape_of(path_of(lab)).alias("shape"), F.col("good").cast("int").alias("good"))
        seen = seen.withColumn("good", F.lit(None).cast("int")).unionByName(told)
    shapes = staged(seen.groupBy("host", "shape").agg(F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("goods")), "url-shapes")
    deepest, goods, labelled = shapes.agg(F.max(F.size(_segments(F.col("shape")))), F.coalesce(F.sum("goods"), F.lit(0)), F.coalesce(F.sum("labelled"), F.lit(0))).first()
    tree, done, kinds = shapes.withColumn("template", F.lit("")), 0, _kinds(shapes)
    for depth in sorted(d for d, n in kinds.items() if n >= s.variable_kinds):
        tree, done = _generalise(_lengthened(tree, done, depth), depth, s), depth + 1
    tree = _lengthened(tree, done, deepest or 0)
    merged = _merge_alike(tree, [d for d, n in kinds.items() if n > 1], s)
    # The pool over all hosts is of unmerged templates, so labels of merged branches stay in it; a merged template goes by
    # the pools of its members.
    over_all = merged.groupBy("template").agg(F.sum("l").alias("all_l"), F.sum("g").alias("all_g"))
    per_host = merged.join(over_all, "template").groupBy("host", "merged").agg(*[F.sum(c).alias(c) for c in ("l", "g", "all_l", "all_g")])
    wide = (F.col("all_g") + s.prior * (goods + 1) / (labelled + 2)) / (F.col("all_l") + s.prior)
    purity = per_host.select("host", "merged", ((F.col("g") + s.prior * wide) / (F.col("l") + s.prior)).alias("purity"))
    verdicts = staged(tree.select("host", "shape", "template").join(merged.select("host", "template", "merged"), ["host", "template"]).join(purity, ["host", "merged"]).select("host", "shape", F.col("merged").alias("template"), "purity"), "url-verdicts")
    joined = base.join(_small(verdicts, s), ["host", "shape"], "left")
    return joined.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), F.when(F.col("purity") < s.reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def _small(df: DataFrame, s: Settings) -> DataFrame:
    """df, marked for broadcast if its strings have at most so many characters."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= s.broadcast else df


def shape_of(path: Column) -> Column:
    """A path's segments without the file extension's variants, those with a digit as *, joined by /."""
    whole = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), "/", -1), lambda x: x != "")
    return F.array_join(F.transform(whole, lambda x: F.when(x.rlike("[0-9]"), F.lit("*")).otherwise(x)), "/")


def _segments(shape: Column) -> Column:
    return F.when(shape == "", F.array().cast("array<string>")).otherwise(F.split(shape, "/", -1))


def _kinds(shapes: DataFrame) -> dict[int, int]:
    """For each level the most literal segments that a host has there: no branch of it has more. A row a level is collected."""
    each = shapes.select("host", F.posexplode(_segments(F.col("shape"))).alias("place", "own")).filter("own <> '*'").distinct()
    most = each.groupBy("host", "place").agg(F.count("*").alias("n")).groupBy("place").agg(F.max("n").alias("n"))
    return {r["place"]: r["n"] for r in most.collect()}


def _lengthened(tree: DataFrame, start: int, stop: int) -> DataFrame:
    """Extends every template by levels start to stop as they are."""
    if stop <= start:
        return tree
    own = F.slice(_segments(F.col("shape")), start + 1, stop - start)
    return tree.withColumn("template", F.concat("template", F.array_join(F.transform(own, lambda x: F.concat(F.lit("/"), x)), "")))


def _generalise(tree: DataFrame, depth: int, s: Settings) -> DataFrame:
    """Extends every template by one level; the segments of branches with many kinds become *."""
    here = tree.withColumn("own", F.get(_segments(F.col("shape")), F.lit(depth)))
    literal = here.filter(F.col("own") != "*")
    kinds = literal.select("host", "template", "own").distinct().groupBy("host", "template").agg(F.count("*").alias("kinds"))
    wide = staged(kinds.filter(F.col("kinds") >= s.variable_kinds).select("host", "template", F.lit(True).alias("wide")), "url-wide")
    step = lambda own: F.when(F.col("own").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), own))
    if wide.isEmpty():
        return here.withColumn("template", step(F.col("own"))).drop("own")
    out = here.join(_small(wide, s), ["host", "template"], "left")
    return staged(out.withColumn("template", step(F.when(F.col("wide"), F.lit("*")).otherwise(F.col("own")))).drop("own", "wide"), "url-tree")


def _classes(siblings: Column, s: Settings) -> Column:
    """Siblings (p, l, g, own), in order of purity, as classes (l, g, owns): each joins the class before it if its purity is
    nearer than the gap to the class's, or nearer than merge_z standard errors of both counts. Classes are at least a
    gap apart, so their intervals of that width differ and name them."""
    kind = "array<struct<l:bigint,g:bigint,owns:array<string>>>"

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = (last["g"] + x["g"]) / (last["l"] + x["l"])
        apart = x["p"] - last["g"] / last["l"]
        alike = (apart < s.merge_gap) | (apart < s.merge_z * F.sqrt(both * (1 - both) * (1 / last["l"] + 1 / x["l"])))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct((last["l"] + x["l"]).alias("l"), (last["g"] + x["g"]).alias("g"), F.concat(last["owns"], F.array(x["own"])).alias("owns"))))
        fresh = F.concat(done, F.array(F.struct(x["l"].alias("l"), x["g"].alias("g"), F.array(x["own"]).alias("owns"))))
        return F.when((F.size(done) > 0) & alike, joined).otherwise(fresh).cast(kind)

    return F.aggregate(siblings, F.array().cast(kind), add)


def _merge_alike(tree: DataFrame, places: list[int], s: Settings) -> DataFrame:
    """(host, template, l, g, merged): the tree's nodes with their labels. Sibling templates of a host, which differ in one
    literal segment only, share a class in that place of merged if their purities are alike. places are the levels where some host has several, from the deepest to the
    first. A branch with more kinds than settings.variable_kinds is *, so the siblings of a place are few."""
    nodes = staged(tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("goods").alias("g")).withColumn("merged", F.col("template")), "url-nodes")
    for place in sorted(places, reverse=True):
        parts = F.split("merged", "/", -1)  # the first part is empty
        own = F.get(parts, F.lit(place + 1))
        here = nodes.withColumn("own", own).withColumn("before", F.slice(parts, 1, F.lit(place + 1))).withColumn("after", F.slice(parts, place + 3, F.greatest(F.size(parts), F.lit(1))))
        now = here.filter(F.col("own") != "*").groupBy("host", "before", "after", "own").agg(F.sum("l").alias("l"), F.sum("g").alias("g")).filter(F.col("l") >= s.prior)
        siblings = now.groupBy("host", "before", "after").agg(F.sort_array(F.collect_list(F.struct((F.col("g") / F.col("l")).alias("p"), "l", "g", "own"))).alias("siblings")).filter(F.size("siblings") > 1)
        classes = siblings.select("host", "before", "after", F.explode(_classes(F.col("siblings"), s)).alias("c")).filter(F.size("c.owns") > 1)
        shared = F.concat(F.lit("{"), F.floor(F.col("c.g") / F.col("c.l") / s.merge_gap).cast("string"), F.lit("}"))
        moved = staged(classes.select("host", "before", "after", F.explode("c.owns").alias("own"), shared.alias("shared")), "url-moved")
        if moved.isEmpty():
            continue
        joined = here.join(_small(moved, s), ["host", "before", "after", "own"], "left")
        nodes = staged(joined.select("host", "template", "l", "g", F.when(F.col("shared").isNotNull(), F.array_join(F.concat("before", F.array("shared"), "after"), "/")).otherwise(F.col("merged")).alias("merged")), "url-nodes")
    return nodes
