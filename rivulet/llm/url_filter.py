"""URL filter: explicit rules, then a path-template tree, in DataFrame operations only.

1. Every url is cut into host and path, and every path into segments; the tree is built from
   counts of distinct (host, segments) pairs.
2. The tree of a host grows from its root, one level at a time. A branch of a node whose share of
   bad labels, all that lies below it counted, differs from that of the whole node (two-sided z test, smoothed
   for few labels) stays literal. All others are variable and are merged: numbers, dates, hexadecimal ids and the like
   into a wildcard of their class, the rest into ``*``. The next level is grown below the merged branches.
3. Below a node without labels, or with labels of one kind only, no branch can differ, so
   all that is below it is merged at once. Rounds go on only as deep as labels of both kinds meet.
4. A template, the way from the root to a leaf, is blocked when its purity, the share of bad among labelled urls
   smoothed towards the host's and the host's towards the overall share,
   reaches ``min_purity``. One without labelled urls never is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import lookup, materialise

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; a null url or one without ``://`` has both empty."""
    text = F.col(url).cast("string")
    start = F.instr(text, "://")
    rest = F.when(start > 0, F.substring(text, start + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^?#]*", 0)
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path")]
    out = pages.select(*keep, rest.alias("_rest"))
    host = F.regexp_extract("_rest", r"^[^/]*", 0)
    out = out.withColumn("_host", host)
    return out.select(*keep, F.translate("_host", _UPPER, _LOWER).alias("host"), F.substring(F.col("_rest"), F.char_length("_host") + 1, F.lit(2**31 - 1)).alias("path"))


def rule_of(rules=RULES):
    """The longest rule that fits host and path, as a column; null if none does."""
    chosen = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, tail = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + tail)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


#: A segment's lexical class, as SQL over ``s``.
LEXICAL = r"""CASE WHEN s rlike '^[0-9]+$' THEN '<n>'
  WHEN s rlike '^[0-9]+[.][A-Za-z]{1,5}$' THEN concat('<n>', regexp_extract(s, '[.][A-Za-z]+$', 0))
  WHEN s rlike '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$' THEN '<date>'
  WHEN s rlike '^[0-9a-fA-F-]{8,}$' THEN '<hex>'
  ELSE s END"""


#: What stands for a segment that is merged, and for one that is not, as SQL over ``s``; a literal never looks like a wildcard.
WILDCARD = f"CASE WHEN ({LEXICAL}) = s THEN '*' ELSE {LEXICAL} END"
LITERAL = "CASE WHEN s rlike '^[=*<]' THEN concat('=', s) ELSE s END"


def path_segments(path: str = "path") -> F.Column:
    """The segments of the path, all of them, joined by ``/``."""
    return F.expr(f"array_join(filter(split({path}, '/'), s -> s != ''), '/')")


def url_keys(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and lex (the segments), and ``_key``, which names the (host, lex) pair."""
    out = url_parts(pages).withColumn("rule", rule_of(rules)).withColumn("lex", path_segments())
    return out.withColumn("_key", F.concat_ws("/", "host", "lex"))


def label_counts(labelled: DataFrame) -> DataFrame:
    """(_key, n_labelled, n_bad) from (url, bad); null labels are left out."""
    known = url_keys(labelled.select("url", "bad"), ()).where(F.col("bad").isNotNull())
    return known.groupBy("_key").agg(F.count("*").alias("n_labelled"), F.count_if("bad").alias("n_bad"))


def template_tree(counts: DataFrame, z: float = 1.96, weight: float = 4.0) -> DataFrame:
    """``counts`` (host, lex, _key, n, n_labelled, n_bad) with the ``template`` each pair belongs to.

    A node is named by its host and the template that leads to it; all joins by node or child are free of
    hot tasks. ``weight`` labels more widen the test of a branch.
    """
    columns = [*counts.columns, "segs", "depth", "template"]
    growing = counts.withColumns({"segs": F.split("lex", "/"), "depth": F.when(F.col("lex") == "", 0).otherwise(F.size(F.split("lex", "/"))), "template": F.lit("")})
    growing, done, level = materialise(growing, "tree"), [], 0
    total = growing.count()
    while total:
        level += 1
        rows = growing.withColumn("node", F.struct("host", "template"))
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("n_labelled").alias("f_l"), F.sum("n_bad").alias("f_b"))
        nodes = materialise(nodes.withColumn("mixed", (F.col("f_b") > 0) & (F.col("f_b") < F.col("f_l"))), "nodes")
        seen = materialise(lookup(rows.withColumnRenamed("n", "pages"), nodes, "node", total).withColumnRenamed("pages", "n"), "seen")
        going = seen.where(F.col("mixed") & (F.col("depth") >= level))
        rest = F.expr(f"transform(slice(segs, {level}, greatest(depth - {level - 1}, 0)), s -> {WILDCARD})")
        merged = F.when(F.col("mixed") | (F.size(rest) == 0), F.col("template")).otherwise(F.concat_ws("/", "template", F.array_join(rest, "/")))
        done.append(seen.where(~F.col("mixed") | (F.col("depth") < level)).withColumn("template", merged).select(*columns))
        total = going.count()
        if not total:
            break
        going = going.withColumn("child", F.struct("host", "template", F.element_at("segs", level).alias("s")))
        children = going.groupBy("child").agg(F.sum("n_labelled").alias("n_l"), F.sum("n_bad").alias("n_b"), F.min("f_l").alias("f_l"), F.min("f_b").alias("f_b"), F.count("*").alias("n"))
        pooled = "(f_b + 1.0D) / (f_l + 2.0D)"
        differs = f"abs(n_b - n_l * {pooled}) > {z}D * sqrt((n_l + {weight}D) * {pooled} * (1.0D - {pooled}))"
        named = children.withColumn("s", F.col("child.s")).selectExpr("child", "n", f"CASE WHEN {differs} THEN {LITERAL} ELSE {WILDCARD} END AS part")
        grown = lookup(going.withColumnRenamed("n", "pages").drop("f_l", "f_b"), materialise(named, "named"), "child", total)
        growing = materialise(grown.withColumns({"template": F.concat_ws("/", "template", "part"), "n": F.col("pages")}).select(*columns), "tree")
    if not done:
        done = [growing]
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return materialise(out.select("host", "lex", "_key", "n", "n_labelled", "n_bad", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template")), "templates-of-paths")


def template_verdicts(tree: DataFrame, min_purity: float = 0.5, weight: float = 4.0) -> DataFrame:
    """(at, n, purity, blocked) of each template; ``at`` is a struct of host and template, ``n`` its pairs. ``weight`` labelled urls stand behind each prior."""
    templates = materialise(tree.groupBy("host", "template").agg(F.sum("n_labelled").alias("n_l"), F.sum("n_bad").alias("n_b"), F.count("*").alias("n")), "templates")
    hosts = templates.groupBy("host").agg(F.sum("n_l").alias("h_l"), F.sum("n_b").alias("h_b"), F.count("*").alias("n"))
    hosts = materialise(hosts, "hosts")
    overall = hosts.agg(((F.coalesce(F.sum("h_b"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("h_l"), F.lit(0)) + 2.0)).alias("g"))  # one row
    hosts = materialise(hosts.join(F.broadcast(overall)).selectExpr("host", "n", f"(h_b + {weight}D * g) / (h_l + {weight}D) AS h_rate"), "host-rates")
    out = lookup(templates.withColumnRenamed("n", "pairs"), hosts, "host", templates.count()).selectExpr("struct(host, template) AS at", "pairs AS n", f"(n_b + {weight}D * h_rate) / (n_l + {weight}D) AS purity", "n_l")
    return out.select("at", "n", "purity", ((F.col("purity") >= min_purity) & (F.col("n_l") > 0)).alias("blocked"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules=RULES, **tree_options) -> DataFrame:
    """Every row of ``pages`` with host, path, rule, template, purity and verdict.

    ``pages`` needs ``url``; ``labelled`` has (url, bad boolean), any number of
    rows for a url, or the counts (_key, n_labelled, n_bad) of ``label_counts``. A
    rule's verdict stands; else the template's, and ``allow``
    where nothing is labelled. Null or malformed urls have an empty host
    and path and are judged as the template ``/`` of the empty host. Very long urls
    are judged whole, by rules and templates. Repeated
    urls count as often as they occur and all get the same verdict; of rules of one length the
    later one in code-point order stands. Other columns
    are kept, save those with the names of new ones; an empty table gives none.
    """
    new = ("host", "path", "rule", "template", "purity", "verdict", "lex", "_key")
    keep = [c for c in pages.columns if c not in new]
    judged = url_keys(pages.select(*[F.col(f"`{c}`") for c in keep]), rules)
    known = label_counts(labelled) if "url" in labelled.columns else labelled
    counts = judged.groupBy("_key", "host", "lex").agg(F.count("*").alias("n")).join(known, "_key", "left").na.fill(0, ["n_labelled", "n_bad"])
    tree = template_tree(counts, **{k: v for k, v in tree_options.items() if k in ("z",)})
    verdicts = materialise(template_verdicts(tree, **{k: v for k, v in tree_options.items() if k in ("min_purity", "weight")}), "verdicts")
    found = lookup(tree.withColumn("at", F.struct("host", "template")).withColumnRenamed("n", "_pages"), verdicts, "at", tree.count())
    found = materialise(found.select("_key", F.col("_pages").alias("n"), "template", "purity", "blocked"), "found")
    decided = F.create_map(*[x for verdict, rule in rules for x in (F.lit(rule), F.lit(verdict))]) if rules else F.create_map(F.lit(""), F.lit("allow"))
    out = lookup(judged, found, "_key", found.agg(F.sum("n")).first()[0] or 0)
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(decided, F.coalesce("rule", F.lit(rules[0][1] if rules else "")))).otherwise(F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
