"""URL filters: explicit rules, and a path-template tree judged by labelled purity, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atelier.llm.common import lower_ascii, stored

#: Everything before the first ``://``, the host, the path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SEP = "/"


def host_of(url: Column) -> Column:
    """Host in lower case (A-Z); empty for null and where there is no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def ruling(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does.

    A rule such as ``example.com/en/`` fits its host and all subdomains, where the path starts with
    the rule's. Of rules of one length the first in order of code points wins.
    """
    which = verdict = F.lit(None).cast("string")
    for rule, outcome in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, _, start = rule.partition(SEP)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(SEP + start)
        which = F.when(fits, F.lit(rule)).otherwise(which)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return which, verdict


def shape(path: Column) -> Column:
    """Segments of a path with runs of digits as ``#``."""
    return F.transform(F.filter(F.split(path, SEP), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "#"))


def depth_of(shapes: DataFrame, least: int, most: int) -> int:
    """Levels of the tree that can have literal segments: those which ``least`` urls reach, ``most`` at most. One row a length is gathered."""
    lengths = shapes.groupBy(F.size("segs").alias("length")).agg(F.sum("n").alias("n")).collect()
    reach = lambda level: sum(r["n"] for r in lengths if r["length"] > level)
    return next((level for level in range(most) if reach(level) < least), most)


def templates(shapes: DataFrame, support: float = 0.01, least: int = 10, most_levels: int = 32) -> DataFrame:
    """Adds ``template`` to distinct shapes (host, segs, n, labelled): a branch's variable segments become ``*``.

    Level by level from the root, a segment stays literal if ``least`` urls with a label have it, however
    few they are of its branch, so that labels alone can tell it from its siblings later; or if it has
    ``support`` of the urls below its host and prefix, and ``least`` of them. All others of that branch are
    generalised together. The tree is as deep as ``least`` urls go; segments beyond, and beyond
    ``most_levels``, are ``*``. Sums are combined before the shuffle; a host of any size is one row a
    distinct segment.
    """
    tree = shapes.withColumn("template", F.array().cast("array<string>"))
    depth = depth_of(shapes, least, most_levels)
    for level in range(depth):
        seg = F.get("segs", F.lit(level))
        at = tree.withColumn("_seg", seg)
        branch = ["host", "template"]
        children = at.where(F.col("_seg").isNotNull()).groupBy(*branch, "_seg").agg(F.sum("n").alias("_n"), F.sum("labelled").alias("_l"))
        whole = children.groupBy(*branch).agg(F.sum("_n").alias("_all"))
        kept = (F.col("_l") >= least) | ((F.col("_n") >= least) & (F.col("_n") >= support * F.col("_all")))
        literal = children.join(whole, branch).where(kept).select(*branch, "_seg", F.lit(True).alias("_literal"))
        named = at.join(literal, [*branch, "_seg"], "left")
        piece = F.when(F.col("_literal"), F.col("_seg")).otherwise("*")
        grown = F.when(F.col("_seg").isNull(), F.col("template")).otherwise(F.concat("template", F.array(piece)))
        tree = stored(named.select(*shapes.columns, grown.alias("template")), "templates")
    rest = F.array_repeat(F.lit("*"), F.greatest(F.size("segs") - depth, F.lit(0)))
    return tree.withColumn("template", F.concat("template", rest))


def branches(tree: DataFrame, z: float = 3.29, least: int = 30, prior: float = 20.0) -> DataFrame:
    """Purity of the branch that each template belongs to: host, template, branch, purity.

    tree: host, template, labelled, bad. A node is a branch of its own where its share of bad labels
    differs from that of the rest of its parent by ``z`` standard errors, both with ``least`` labels;
    else it is merged with its parent, up to the host and the whole. A template belongs to its deepest
    node that is a branch. purity is that branch's share of bad labels, drawn to the overall share by
    ``prior`` labels' weight.
    """
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("template") + 1), lambda k: F.when(k == 0, F.array(F.lit(""))).otherwise(F.concat(F.array(F.col("host")), F.slice("template", 1, k - 1))))
    nodes = stored(leaves.select("host", "template", "labelled", "bad", F.explode(prefixes).alias("node")), "nodes")
    sums = stored(nodes.groupBy("node").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")), "sums")
    root = F.array(F.lit(""))
    parent = F.when(F.col("node") == root, None).when(F.size("node") == 1, root).otherwise(F.slice("node", 1, F.size("node") - 1))
    over = sums.select(F.col("node").alias("parent"), F.col("n").alias("pn"), F.col("b").alias("pb"))
    both = sums.withColumn("parent", parent).join(over, "parent", "left")
    n2, b2 = F.col("pn") - F.col("n"), F.col("pb") - F.col("b")
    pooled = F.col("pb") / F.greatest(F.col("pn"), F.lit(1))
    enough = (F.col("n") >= least) & (n2 >= least)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("n"), F.lit(1)) + 1 / F.greatest(n2, F.lit(1))))
    apart = enough & (F.abs(F.col("b") / F.greatest(F.col("n"), F.lit(1)) - b2 / F.greatest(n2, F.lit(1))) > z * error)
    own = both.where(F.coalesce(apart, F.lit(False)) | (F.col("node") == root)).select("node", "n", "b")
    share = own.where(F.col("node") == root).select((F.col("b") / F.greatest(F.col("n"), F.lit(1))).alias("p")).first()
    p = share["p"] if share else 0.0
    level = F.when(F.col("node") == root, 0).otherwise(F.size("node"))
    return (
        nodes.select("host", "template", "node")
        .join(own, "node")
        .groupBy("host", "template")
        .agg(F.max_by(F.struct("node", "n", "b"), level).alias("s"))
        .select("host", "template", F.col("s.node").alias("branch"), ((F.col("s.b") + prior * p) / (F.col("s.n") + prior)).alias("purity"))
    )


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], block_at: float = 0.5) -> DataFrame:
    """Verdict on every url.

    pages: page_id and url; labels: url_key and bad (boolean); url_key is the last number in a url's
    path. Other columns are ignored. Returns page_id, host, path, rule, verdict (the longest fitting
    rule's; else block where the template's smoothed share of bad labels is ``block_at`` or more),
    template and purity. Null urls and those without ``://`` have empty host and path and are judged
    as that host; repeated rows are judged alike; a key labelled twice is bad if any label says so;
    without labels, only rules block; an empty table gives an empty result.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("segs", shape(F.col("path")))
    key = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^/0-9]*/?$', 1), '') as bigint)")
    truth = labels.where("url_key is not null").groupBy("url_key").agg(F.max("bad").alias("bad"))
    known = (
        parsed.withColumn("url_key", key)
        .join(truth, "url_key", "left")
        .groupBy("host", "segs")
        .agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.count_if("bad").alias("bad"))
    )
    tree = templates(stored(known, "shapes"))
    judged = tree.select("host", "segs", "template").join(stored(branches(tree), "branches"), ["host", "template"])
    rule, verdict = ruling(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") >= block_at, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(stored(judged, "judged"), ["host", "segs"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.concat(F.lit(SEP), F.array_join("template", SEP)).alias("template"), "purity",
    )
