"""URL filter: rules for hosts and paths, else trust and distrust spread over the links between hosts.

A page's url is judged by the longest rule that fits. Other pages follow their host: trust is a personalised
PageRank over the links, starting from the hosts of allowed pages; distrust is one over the reversed links,
starting from the hosts of blocked pages. A host is blocked if its distrust exceeds ``threshold`` of both;
one that neither reaches is allowed.

Links are the ``href`` values of a page, counted by pair of hosts before anything is joined; relative ones
lead to the page's own host. A host without links gives its weight back to the seeds. Each round is one
equi-join and one sum with map-side combine, cut by a written table; adaptive execution splits large hosts.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and no links; null html has
no links; rows with a null identifier and repeated rows are judged each; without seeds of a kind its scores
are 0; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import cut, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, CLOSE, THRESHOLD = 0.85, 1e-6, 0.5
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


def _after(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    name = F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1)
    return F.translate(name, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits the columns ``host`` and ``path``; nulls without one."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(src, dst, n)``: links between hosts, from pages with a column ``host``."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_HREF), 1)).alias("to"))
    to = F.when(F.col("to").rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), host(F.col("to"))).when(F.col("to").startswith("//"), host(F.concat(F.lit("x:"), F.col("to")))).when(
        ~F.col("to").rlike(r"^(?i)(#|[a-z][a-z0-9+.-]*:)"), F.col("src"))
    return found.select("src", to.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, close: float = CLOSE) -> DataFrame:
    """``(host, score)`` for all hosts with a score: personalised PageRank over ``edges(src, dst, n)`` from
    ``seeds(host, weight)``. Ends once scores change by less than ``close`` in sum, or after
    ``rounds`` if given."""
    all_weight = seeds.agg(F.sum("weight")).first()[0]
    if not all_weight:
        return seeds.select("host", F.lit(0.0).alias("score")).limit(0)
    start = cut(seeds.select("host", (F.col("weight") / F.lit(float(all_weight))).alias("seed")), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    steps = cut(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "steps")
    now = start.select("host", F.col("seed").alias("score"))
    # a round leaves at most ``damping`` of the change of the one before, which was 2 at most
    most = math.ceil(math.log(close / 2) / math.log(damping)) + 10 if rounds is None else rounds
    for _ in range(most):
        moved = now.join(steps, now["host"] == steps["src"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        moved = cut(moved, "moved")
        kept = moved.agg(F.sum("got")).first()[0] or 0.0  # the rest was at hosts without links
        back = 1 - damping * kept
        new = start.join(moved, "host", "full").select("host", (F.coalesce("seed", F.lit(0.0)) * back + damping * F.coalesce("got", F.lit(0.0))).alias("score"))
        new = cut(new, "rank")
        old = now.select("host", F.col("score").alias("old"))
        change = new.join(old, "host", "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        now = new
        if change < close:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"scores still change by {change} after {most} rounds")
    return now


def host_scores(pages: DataFrame, html: str = "html", **rank) -> DataFrame:
    """``(host, trust, distrust)`` of the hosts that either reaches; ``pages`` has ``host`` and ``ruled``."""
    edges = cut(links(pages, html), "links")
    seeds = cut(pages.where("host <> '' and ruled is not null").groupBy("host", "ruled").agg(F.count("*").cast("double").alias("weight")), "ruled")
    of = lambda v: seeds.where(F.col("ruled") == v).select("host", "weight")
    trust = pagerank(edges, of("allow"), **rank).withColumnRenamed("score", "trust")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = pagerank(turned, of("block"), **rank).withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, page_id: str = "page_id",
          url: str = "url", html: str = "html", **rank) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` for every row of ``pages``."""
    name, verdict = rule(rules)
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.col(html).alias("html"))
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    scores = cut(host_scores(rows, "html", **rank), "hosts")
    by_host = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), "block").otherwise("allow")
    return rows.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    return judge(table(spark, sf_dir, "pages"))
