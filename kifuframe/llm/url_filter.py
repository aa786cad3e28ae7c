"""URL filter: host and path rules, and where none fits, a tree of path templates per host.

Only DataFrame functions. The tree grows level by level over the distinct paths: in each node (host and template so far)
the frequent next segments with enough labels stay as they are, all others become a wildcard; of the kept ones, those whose
labelled shares do not differ significantly merge into one branch. A template is rejected when its labelled share of bad
pages, smoothed towards that of its host and this towards that of all pages, reaches a limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kifuframe.llm.common import LOWER, UPPER, fresh, stored

#: Levels of the tree; what lies below is one wildcard.
LEVELS = 4
#: A segment stays when it has one in so many of its node's pages, and labels.
ONE_IN, LEAST_LABELS = 20, 5
#: Two shares differ when their distance is more than so many standard errors.
ERRORS = 1.96
#: Weight of what a share is smoothed towards, in labels, and the share from which a template is rejected.
SMOOTHING, REJECT = 4.0, 0.5
WILD, REST = "*", "**"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` with A-Z lowered, and path without query and fragment; null or no ``://`` give empty ones."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text (host and path) and verdict of the longest rule that fits the host, or a domain above it, and begins the path.

    ``rules`` are ``verdict, host, path``. They are literals of the expression: meant for lists of some hundred.
    """
    best = reduce(lambda rest, rule: F.when(
        ((host == rule[1]) | host.endswith(f".{rule[1]}")) & path.startswith(rule[2]),
        F.struct(F.lit(rule[1] + rule[2]).alias("rule"), F.lit(rule[0]).alias("verdict"))).otherwise(rest),
        sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)),
        F.lit(None).cast("struct<rule:string,verdict:string>"))
    return best["rule"], best["verdict"]


def _branches(rows: DataFrame, segment: Column) -> DataFrame:
    """``h, t, s, branch`` of the segments that stay in their nodes: at most ``ONE_IN`` a node."""
    kids = rows.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(
        F.sum("pages").alias("pages"), F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    nodes = kids.groupBy(F.col("host").alias("nh"), F.col("template").alias("nt")).agg(F.sum("pages").alias("all"))
    frequent = kids.where(F.col("labels") >= LEAST_LABELS).join(
        nodes, (F.col("host") == F.col("nh")) & (F.col("template") == F.col("nt"))).where(F.col("pages") * ONE_IN >= F.col("all"))
    node = Window.partitionBy("host", "template")
    order = node.orderBy("share", "segment")
    before = lambda c: F.lag(c).over(order)
    pooled = (F.col("bad") + before("bad")).cast("double") / (F.col("labels") + before("labels"))
    error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / F.col("labels") + 1.0 / before("labels")))
    apart = F.col("share") - before("share") > ERRORS * error
    groups = frequent.withColumn("share", F.col("bad").cast("double") / F.col("labels")) \
        .withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("group", F.sum("apart").over(order))
    names = F.collect_list("segment").over(Window.partitionBy("host", "template", "group"))
    return groups.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("segment").alias("s"),
                         F.array_join(F.sort_array(names), "|").alias("branch"))


def path_templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``host, path, template, pages, labels, bad`` for a table ``host, path, pages, labels, bad`` of distinct paths."""
    segments = F.slice(F.split("path", "/"), 2, 1 << 30)  # a path begins with a slash; an empty one has no segments
    rows = stored(paths.select("*", segments.alias("segments"), F.lit("").alias("template")), "url-paths", small=True)
    for level in range(levels):
        here = F.get("segments", F.lit(level))
        branches = _branches(rows, here)
        named = rows.withColumn("here", here).join(
            branches, (F.col("host") == F.col("h")) & (F.col("template") == F.col("t")) & (F.col("here") == F.col("s")), "left")
        step = F.when(F.col("here").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("branch", F.lit(WILD))))
        rows = stored(named.select(*paths.columns, "segments", F.concat("template", step).alias("template")), "url-paths", small=True)
    tail = F.when(F.size("segments") > levels, F.lit(f"/{REST}")).otherwise(F.lit(""))
    return rows.select(*paths.columns, F.concat("template", tail).alias("template"))


def template_verdicts(templates: DataFrame) -> DataFrame:
    """``host, template, bad_share, verdict`` of each template."""
    tallies = [F.sum("labels").alias("labels"), F.sum("bad").alias("bad")]
    own = templates.groupBy("host", "template").agg(*tallies)
    hosts = own.groupBy(F.col("host").alias("h")).agg(F.sum("labels").alias("host_labels"), F.sum("bad").alias("host_bad"))
    labels, bad = own.agg(*tallies).first()
    overall = ((bad or 0) + 1.0) / ((labels or 0) + 3.0)  # a third where nothing is known
    of_host = (F.col("host_bad") + SMOOTHING * F.lit(overall)) / (F.col("host_labels") + SMOOTHING)
    share = (F.col("bad") + SMOOTHING * of_host) / (F.col("labels") + SMOOTHING)
    return own.join(hosts, F.col("host") == F.col("h")).select(
        "host", "template", share.alias("bad_share"), F.when(share >= REJECT, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = (), page_id: str = "page_id",
               url: str = "url", label_id: str = "page_id", bad: str = "bad", levels: int = LEVELS) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, template, bad_share``.

    ``labels`` says of some pages whether they are bad (boolean); a page with several labels is bad if one says so, null labels
    say nothing. The verdict is that of the longest rule that fits, else that of the url's template.

    * A null url, and one without ``://``, has an empty host and path; these form one template. A null id has no label.
    * Every row counts as a page, repeated ones too. An empty table gives an empty table; without labels all is allowed.
    * Input columns with the names of the added ones are replaced.
    """
    added = ("host", "path", "rule", "verdict", "template", "bad_share")
    given = [c for c in pages.columns if c.lower() not in added]
    ident, is_bad, h, p = fresh(pages, "label", "bad", "h", "p")
    host, path = host_and_path(F.col(url))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    placed = pages.withColumns({h: host, p: path}).select(
        *[F.col(c) for c in given], F.col(h).alias("host"), F.col(p).alias("path"))
    known = labels.where(F.col(bad).isNotNull()).groupBy(F.col(label_id).alias(ident)).agg(F.max(F.col(bad).cast("int")).alias(is_bad))
    paths = placed.select(F.col(page_id), "host", "path").join(known, F.col(page_id) == F.col(ident), "left").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count(is_bad).alias("labels"), F.coalesce(F.sum(is_bad), F.lit(0)).alias("bad"))
    templates = path_templates(paths, levels)
    verdicts = template_verdicts(templates).select(F.col("host").alias("th"), F.col("template").alias("tt"), "bad_share", "verdict")
    judged = stored(templates.join(verdicts, (F.col("host") == F.col("th")) & (F.col("template") == F.col("tt"))).select(
        F.col("host").alias(h), F.col("path").alias(p), "template", "bad_share", "verdict"), "url-verdicts", small=True)
    return placed.join(judged, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p))).select(
        *given, "host", "path", rule.alias("rule"), F.coalesce(ruled, F.col("verdict")).alias("verdict"), "template", "bad_share")
