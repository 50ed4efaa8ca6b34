"""URL filtering by rules and by a tree of path templates with labelled purity.

Paths become templates per host: depth by depth, the children of a node turn into one
wildcard where the counts say that the segment varies: many different children that occur
only a few times each, fewer being enough where segments look like numbers, hashes or ids. Then
sibling branches at every depth, from the leaves up, are merged if the share of good labels below them doesn't
differ from their siblings' by a two-proportion test. The
purity of a node is smoothed towards its parent's, from the host down, the host's towards that
of the whole corpus; templates below ``least`` are rejected.

All steps but the first and the last work on distinct paths, which a grouped sum
makes of the rows, so a host with a third of all rows is a few rows in every table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Children of a node from which on they may be variable, those that look so and all; how often each
#: then occurs on average at most; weight of the prior; least purity; quantile of the test.
FEW, MANY, OFTEN, SMOOTH, LEAST, Z = 3, 12, 4, 5.0, 0.5, 1.96
WILD = "*"
BROADCAST_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of ``rules`` (``host/path`` to allow or block) that fits, else null. A rule
    fits its host and all subdomains if the path starts with the rule's."""
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, start = rule.partition("/")
        found.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string"))


def looks_variable(segment: Column) -> Column:
    """A number, a hash or an id by its looks, perhaps with a suffix: a hint only."""
    return segment.rlike(r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9a-fA-F]{8}-[0-9a-fA-F-]{27})(?:\.[A-Za-z0-9]{1,5})?$") | segment.rlike("[0-9]{4,}")


def _common(low: Column, high: Column) -> Column:
    """How many segments all arrays between these two begin with."""
    return F.transform(F.array(F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)), lambda k: F.when(k == 0, F.size(low)).otherwise(k - 1).cast("int"))[0]


def _levels(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, shape, n, labelled, good) with ``template``, an array of the path's segments with
    variable ones generalised.

    A step goes on from all nodes at once: first along the segments that all paths of a node share, which can't
    vary, then over one branching. So there are as many steps as a path has branchings, however deep it is."""
    rest = F.regexp_replace("shape", "^/+", "")
    tree = shapes.withColumn("segments", F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "/"))).withColumn("template", F.array().cast("array<string>"))
    more, d = F.size("segments") > F.size("template"), 0
    tree = scratch.keep(tree, "level0")
    while not tree.where(more).isEmpty():
        left = F.slice("segments", F.size("template") + 1, F.size("segments"))
        spans = tree.where(more).groupBy("host", "template").agg(F.min(left).alias("low"), F.max(left).alias("high")).select("host", "template", _common(F.col("low"), F.col("high")).alias("skip"))
        here = tree.join(spans, ["host", "template"], "left").withColumn("template", F.concat("template", F.slice(left, 1, F.coalesce("skip", F.lit(0))))).drop("skip")
        here = here.withColumn("segment", F.get("segments", F.size("template"))).withColumn("looks", F.coalesce(looks_variable(F.col("segment")), F.lit(False)))
        here = scratch.keep(here, f"along{d}")
        children = here.where("segment is not null").groupBy("host", "template", "looks", "segment").agg(F.sum("n").alias("n"))
        wide = children.groupBy("host", "template", "looks").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"))
        wide = wide.where(f"kinds >= if(looks, {FEW}, {MANY}) and total <= {OFTEN} * kinds").select("host", "template", "looks", F.lit(True).alias("wide"))
        here = here.join(wide, ["host", "template", "looks"], "left")
        name = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.array(F.when(F.col("wide"), WILD).otherwise(F.col("segment")))))
        tree = scratch.keep(here.withColumn("template", name).drop("segment", "looks", "wide"), f"level{d + 1}")
        scratch.drop(f"level{d}", f"along{d}")
        d += 1
    return tree.drop("segments")


def _nodes_of(template: Column) -> Column:
    """The path's nodes from the root down: (depth, node, parent), names by a chain of hashes, so that a
    path's nodes take as much room as it has segments."""
    first = F.struct(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("node"), F.lit("").alias("parent"))).alias("nodes"), F.lit("").alias("last"))

    def step(s: Column, segment: Column) -> Column:
        def on(name: Column) -> Column:
            one = F.struct(F.size(s["nodes"]).alias("depth"), name.alias("node"), s["last"].alias("parent"))
            return F.struct(F.concat(s["nodes"], F.array(one)).alias("nodes"), name.alias("last"))

        return F.transform(F.array(F.md5(F.concat(s["last"], F.lit("/"), segment))), on)[0]

    return F.aggregate(template, first, step)["nodes"]


def purities(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """``shapes`` (host, shape, n, labelled, good) to (host, shape, template, merged, purity)."""
    tree = scratch.keep(_levels(shapes, scratch), "tree")
    all_n, all_g = tree.agg(F.sum("labelled"), F.sum("good")).first()
    base = ((all_g or 0.0) + 1.0) / ((all_n or 0.0) + 2.0) if all_n else 1.0
    # every node: (host, node, parent, n, g), its whole subtree's labels
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("good").alias("g"))
    paths = scratch.keep(leaves.select("host", "template", "n", "g", F.inline(_nodes_of(F.col("template")))), "paths")
    nodes = scratch.keep(paths.groupBy("host", "node", "parent").agg(F.sum("n").alias("n"), F.sum("g").alias("g")), "nodes")
    below = nodes.where("node != ''").groupBy("host", "parent").agg(F.sum("n").alias("n_all"), F.sum("g").alias("g_all"))
    own = nodes.where("node != ''").join(below, ["host", "parent"])
    others, rest, pooled = F.col("n_all") - F.col("n"), F.col("g_all") - F.col("g"), F.col("g_all") / F.col("n_all")
    gap = F.col("g") / F.col("n") - rest / others
    differs = gap * gap > Z * Z * pooled * (1 - pooled) * (1 / F.col("n") + 1 / others)
    own = own.withColumn("merged", ~F.when((F.col("n") > 0) & (others > 0), differs).otherwise(False))
    group = own.where("merged").groupBy("host", "parent").agg(F.sum("n").alias("n_group"), F.sum("g").alias("g_group"))
    own = own.join(group, ["host", "parent"], "left").select("host", "node", "merged", F.when(F.col("merged"), F.col("n_group")).otherwise(F.col("n")).alias("n"), F.when(F.col("merged"), F.col("g_group")).otherwise(F.col("g")).alias("g"))
    own = own.unionByName(nodes.where("node = ''").select("host", "node", F.lit(False).alias("merged"), "n", "g"))
    # each template's nodes from the root down, at most its segments and the host, smoothed one by one
    down = paths.select("host", "template", "depth", "node").join(scratch.keep(own, "own"), ["host", "node"])
    down = down.groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("depth", "n", "g", "merged"))).alias("nodes"))
    purity = F.aggregate("nodes", F.lit(base), lambda above, x: (x["g"] + SMOOTH * above) / (x["n"] + SMOOTH))
    found = down.select("host", "template", F.element_at("nodes", -1)["merged"].alias("merged"), purity.alias("purity"))
    return tree.select("host", "shape", "template").join(found, ["host", "template"]).withColumn("template", F.concat(F.when(F.size("template") > 0, "/").otherwise(""), F.array_join("template", "/")))


def judge(pages: DataFrame, labels: DataFrame, rules: dict[str, str], scratch: Scratch, url_col: str = "url", key: Column | None = None, label_col: str = "good") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``template``, ``purity``, ``rule`` and ``verdict``, in
    place of columns of those names. ``labels``: (key, label 0/1); ``key`` is a column
    expression on pages that finds a page's label.

    Null urls, and those without ``://``, have the empty host and path. Repeated labels
    of a key count by their mean; null keys and labels don't count. Without labels nothing
    is rejected but by rules. Repeated rows pass through; an empty table gives no rows."""
    added = ("host", "path", "template", "purity", "rule", "verdict")
    keep = [c for c in pages.columns if c not in added]
    # columns by number, so that those which the caller doesn't select aren't read, let alone shuffled
    rows = pages.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.col(url_col).alias("__url"), (key if key is not None else F.lit(None)).cast("string").alias("__key"))
    rows = rows.select(*[f"__{i}" for i in range(len(keep))], host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"), "__key").withColumn("shape", F.regexp_replace("path", "/+$", ""))
    known = labels.select(F.col("key").cast("string").alias("__key"), F.col(label_col).cast("double").alias("label")).where("__key is not null and label is not null").groupBy("__key").agg(F.avg("label").alias("label"))
    counts = rows.select("host", "shape", "__key").groupBy("host", "shape", "__key").agg(F.count("*").alias("n"))
    counts = counts.join(known, "__key", "left").groupBy("host", "shape").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0)).cast("double").alias("labelled"), F.sum(F.coalesce(F.col("label") * F.col("n"), F.lit(0.0))).alias("good"))
    found = scratch.keep(purities(scratch.keep(counts, "shapes"), scratch), "templates")
    small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    judged = rows.join(small, ["host", "shape"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])[F.col("rule")] if rules else F.lit(None).cast("string")
    out = judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, F.when(F.col("purity") < LEAST, "block").otherwise("allow")))
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], *added)
