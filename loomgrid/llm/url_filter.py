"""URL filters, in DataFrame functions only: fixed rules, and a tree of path templates per host.

1. The segments of a path are generalised by their form (numbers, hexadecimal, dates, long mixtures).
   Equal (host, form) rows are added up before anything else, so a hot host is a few rows from there.
2. Level by level, a segment that is rare among the many children of its node becomes a wildcard, unless
   its labels set it apart; then the branches of a node whose labelled shares do not differ statistically
   from the node's own are merged, and branches without labels join them. Segments below ``DEPTH`` keep
   their form and are told apart, but are not generalised any further.
3. The purity of a template is the blocked share among labelled urls: that of its branch, smoothed towards
   its parent's, and so on up the tree to the host, the domain and all urls. It is rejected where the
   purity reaches the threshold and its host has ``MIN_LABELS`` labels at least. Labels are the verdicts
   of the rules.

A url that a rule fits takes the longest rule's verdict; any other takes that of its template. So a section
of a site of which nothing is known goes with the labelled sections of the site, if these agree.

Defined cases: a null url or one without ``://`` has empty host and path, no labels, and is allowed;
repeated rows count as often as they occur and get equal rows; null ids stay null; an empty path is the
host's root; a share that ties with the threshold is rejected; columns named like ours (host, path, rule,
verdict, template) are ignored; without rules that fit, nothing is labelled and all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, drop

#: Fixed values: (verdict, rule); a rule is a host with all its subdomains and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

DEPTH = 8
MIN_SHARE = 0.02
MAX_CHILDREN = 16
PRIOR_WEIGHT = 5.0
MIN_LABELS = 3
THRESHOLD = 0.8
#: Standard deviations beyond which two labelled shares differ.
DIFFER = 2.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own_host, slash, own_path = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + own_path)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def form_of(segment: Column) -> Column:
    """A segment with its variable parts generalised; an extension stays."""
    stem = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?\z", 1)
    tail = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z][A-Za-z0-9]{0,4})?\z", 2)
    form = (
        F.when(stem.rlike(r"^[0-9]+\z"), "{n}")
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?\z"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{8,}\z") & stem.rlike("[0-9]"), "{hex}")
        .when(stem.rlike(r"(?s)^.{20,}\z") & stem.rlike("[0-9]"), "{id}")
        .otherwise(F.regexp_replace(stem, r"[0-9]+", "{n}"))
    )
    return F.concat(form, tail)


def _differs(labelled: Column, blocked: Column, above_l: Column, above_b: Column) -> Column:
    """Whether a branch's labelled share is further from its node's than chance explains."""
    share, whole = F.try_divide(blocked, labelled), F.try_divide(above_b, above_l)
    spread = (above_b + 1) * (above_l - above_b + 1) / ((above_l + 2) * (above_l + 2))
    return F.coalesce(F.abs(share - whole) > DIFFER * F.sqrt(F.try_divide(spread, labelled)), F.lit(False))


def templates(paths: DataFrame) -> DataFrame:
    """(host, path_form, template, chain) for rows (host, path_form, form, labelled, blocked, n, chain).

    ``form`` is the array of segments; ``chain`` has (labelled, blocked) of everything above, outermost
    first, and goes on with those of each branch.
    """
    node = ["host", "node"]
    out = paths.withColumn("node", F.lit(""))
    made = None
    for level in range(1, DEPTH + 1):
        if out.where(F.size("form") >= level).isEmpty():
            break
        rows = out.withColumn("segment", F.get(F.col("form"), F.lit(level - 1)))
        sums = [F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b")]
        children = rows.where(F.col("segment").isNotNull()).groupBy(*node, "segment").agg(*sums)
        nodes = children.groupBy(*node).agg(F.sum("n").alias("whole"), F.count("*").alias("kinds"), F.sum("l").alias("above_l"), F.sum("b").alias("above_b"))
        apart = _differs(F.col("l"), F.col("b"), F.col("above_l"), F.col("above_b"))
        literal = (F.col("kinds") <= MAX_CHILDREN) | (F.col("n") >= MIN_SHARE * F.col("whole")) | ((F.col("l") >= MIN_LABELS) & apart)
        step = F.when(literal, F.concat(F.lit("/"), "segment")).otherwise("/*")
        children = cut(children.join(nodes, node).withColumn("step", step), "url-children")
        branch = children.groupBy(*node, "step").agg(
            F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("above_l").alias("above_l"), F.first("above_b").alias("above_b")
        )
        alike = (F.col("above_l") > 0) & ~_differs(F.col("l"), F.col("b"), F.col("above_l"), F.col("above_b"))
        branch = cut(branch.withColumn("label", F.when(alike, "/{~}").otherwise(F.col("step"))), "url-branches")
        merged = branch.groupBy(*node, "label").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
        merged = merged.select(*node, "label", F.struct(F.col("l").alias("labelled"), F.col("b").alias("blocked")).alias("own"))
        taken = children.select(*node, "segment", "step").join(branch.select(*node, "step", "label"), [*node, "step"]).join(merged, [*node, "label"])
        rows = rows.join(taken.select(*node, "segment", "label", "own"), [*node, "segment"], "left")
        rows = rows.withColumn("node", F.concat("node", F.coalesce("label", F.lit(""))))
        rows = rows.withColumn("chain", F.when(F.col("own").isNull(), F.col("chain")).otherwise(F.array_append("chain", F.col("own"))))
        out = cut(rows.drop("segment", "label", "own"), "url-level")  # a level is a table of its own
        drop(children, branch, *([made] if made is not None else []))
        made = out
    deeper = F.when(F.size("form") > DEPTH, F.concat(F.lit("/"), F.array_join(F.slice("form", DEPTH + 1, F.greatest(F.size("form") - DEPTH, F.lit(0))), "/")))
    return out.select("host", "path_form", F.concat("node", F.coalesce(deeper, F.lit(""))).alias("template"), "chain")


def purity(chain: Column) -> Column:
    """Blocked share at the end of a chain, each link smoothed towards the one before; 0 without any label."""
    step = lambda above, x: (x["blocked"] + PRIOR_WEIGHT * above) / (x["labelled"] + PRIOR_WEIGHT)
    whole = F.coalesce(F.try_divide(chain[0]["blocked"], chain[0]["labelled"]), F.lit(0.0))
    return F.aggregate(F.slice(chain, F.lit(2), F.size(chain) - 1), whole, step)


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per page: id, host, path, rule, verdict, template."""
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    forms = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), form_of)
    base = base.select("*", rule.alias("rule"), verdict.alias("given"), F.array_join(forms, "/").alias("path_form"))
    sums = base.groupBy("host", "path_form").agg(
        F.count("*").alias("n"), F.count("given").alias("labelled"), F.count(F.when(F.col("given") == "block", 1)).alias("blocked")
    )
    sums = cut(sums.withColumn("form", F.filter(F.split("path_form", "/"), lambda s: s != "")), "url-forms")
    link = F.struct(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    domain = F.substring_index("host", ".", -2)
    whole = sums.agg(link.alias("x")).select(F.coalesce("x.labelled", F.lit(0)), F.coalesce("x.blocked", F.lit(0))).first()
    hosts = cut(sums.groupBy("host").agg(link.alias("own")).withColumn("domain", domain), "url-hosts")
    above = hosts.groupBy("domain").agg(F.struct(F.sum("own.labelled").alias("labelled"), F.sum("own.blocked").alias("blocked")).alias("dom"))
    top = F.struct(F.lit(whole[0]).cast("long").alias("labelled"), F.lit(whole[1]).cast("long").alias("blocked"))
    hosts = hosts.join(above, "domain").select("host", F.array(top, F.col("dom"), F.col("own")).alias("chain"))
    found = templates(sums.join(hosts, "host"))
    known = F.col("chain")[2]["labelled"] >= MIN_LABELS
    found = found.select("host", "path_form", "template", (known & (purity(F.col("chain")) >= THRESHOLD)).alias("rejected"))
    lookup = cut(found, "url-lookup")
    drop(sums)
    method = F.when(F.col("rejected"), "block").otherwise("allow")
    return base.join(lookup, ["host", "path_form"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "template"
    )
