"""URL verdicts from host rules and, where no rule fits, from trust that spreads over the link graph.

Personalised PageRank runs from trusted seeds along the links between hosts, and from blocked seeds
against them: who links to a blocked host earns distrust. A host's scores are measured per page, so
that a host whose every page is a seed and that no one links to scores one; a host whose distrust
exceeds its trust by the threshold is blocked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, ascii_lower, spread_join

#: Fixed values: (verdict, rule).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: An anchor that doesn't end before the next < has no link; so no search runs over another anchor's text.
LINK = r"(?i)<a\s[^<>]*?\bhref\s*=\s*[\"']?([^\"'<>\s]+)"


def parse(url):
    """(host, path) columns of a URL; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def host_rules(hosts: DataFrame, rules) -> DataFrame:
    """(host, rules): per host, the rules that fit it, longest first, as (length, rule, verdict, path)."""
    rows = [(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for v, r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "suffix string, path string, rule string, verdict string")
    # a rule's host is a suffix of as many labels as it has: others are never built
    labels = sorted({s.count(".") + 1 for s, *_ in rows})
    last = F.array(*[F.substring_index("host", ".", -n) for n in labels])
    one = F.struct(F.length("rule").alias("length"), "rule", "verdict", "path")
    return hosts.select("host", F.explode(F.array_distinct(last)).alias("suffix")).join(table, "suffix").groupBy("host").agg(F.sort_array(F.collect_set(one), asc=False).alias("rules"))


def spread(stage: Stage, nodes: DataFrame, edges: DataFrame, damping: float, close: float) -> DataFrame:
    """(host, trust, distrust) by power iteration from the seeds (t0, d0) of nodes, along and against edges (src, dst, w).

    Goes on until a round moves less than ``close`` in all; each moves at most ``damping`` of what the one
    before it moved, so that takes log(close) / log(damping) rounds and a few. Each round is written.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("out_w"))
    back = edges.groupBy("dst").agg(F.sum("w").alias("in_w"))
    e = stage.put(edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("w") / F.col("out_w")).alias("p"), (F.col("w") / F.col("in_w")).alias("q")))
    gives = nodes.join(out.select(F.col("src").alias("host"), F.lit(True).alias("along")), "host", "left").join(back.select(F.col("dst").alias("host"), F.lit(True).alias("against")), "host", "left")
    now = stage.put(gives.select("host", "t0", "d0", F.coalesce("along", F.lit(False)).alias("along"), F.coalesce("against", F.lit(False)).alias("against"), F.col("t0").alias("trust"), F.col("d0").alias("distrust"), F.lit(0.0).alias("moved")))
    passed = lambda: now.agg(F.sum(F.when(F.col("along"), F.col("trust"))), F.sum(F.when(F.col("against"), F.col("distrust"))), F.sum("moved")).first()
    t, d, _ = passed()
    while True:
        along = e.join(now.select(F.col("host").alias("src"), "trust"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("p") * F.col("trust")).alias("t"))
        against = e.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("q") * F.col("distrust")).alias("d"))
        got = now.join(along, "host", "left").join(against, "host", "left").na.fill(0.0, ["t", "d"])
        # what hosts without links would pass on returns to the seeds
        trust, distrust = damping * F.col("t") + (1 - damping * (t or 0.0)) * F.col("t0"), damping * F.col("d") + (1 - damping * (d or 0.0)) * F.col("d0")
        moved = F.abs(trust - F.col("trust")) + F.abs(distrust - F.col("distrust"))
        old, now = now, stage.put(got.select("host", "t0", "d0", "along", "against", trust.alias("trust"), distrust.alias("distrust"), moved.alias("moved")))
        stage.drop(old)
        t, d, moved = passed()
        if (moved or 0.0) < close:
            return now.select("host", "trust", "distrust")


def judge(df: DataFrame, rules=RULES, damping: float = 0.85, close: float = 1e-6, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of (page_id, url, html).

    The longest rule that fits decides (of equally long ones, the last in code-point order). Other
    pages take their host's verdict: block if distrust exceeds trust by more than ``threshold``.
    Links are the hrefs of anchors; relative ones stay on their host and carry nothing.

    Null url or one without ://: empty host and path, no rule, allowed. Null html: no links. Null or
    repeated page_ids keep their rows; repeated rows count as pages each. Empty input: no rows.
    Other columns are ignored.
    """
    stage = Stage(df.sparkSession, "urls")
    host, path = parse(F.col("url"))
    to = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    pages = stage.put(df.select("page_id", host.alias("host"), path.alias("path"), F.filter(F.transform(to, lambda x: ascii_lower(F.regexp_extract(x, r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)", 1))), lambda x: x != "").alias("links")))
    named = pages.where("host <> ''")
    fitting = host_rules(named.select("host").distinct(), rules)
    ruled = spread_join(pages.select("page_id", "host", "path"), fitting, ["host"], F.struct("page_id", "path"))
    hit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    ruled = stage.put(ruled.select("page_id", "host", "path", hit["rule"].alias("rule"), hit["verdict"].alias("verdict")))

    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    edges = named.select(F.col("host").alias("src"), F.explode("links").alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    nodes = stage.put(seeds.join(linked, "host", "full").na.fill(0, ["pages", "good", "bad"]))
    good, bad = nodes.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    start = nodes.select("host", (F.col("good") / F.lit(float(max(good, 1)))).alias("t0"), (F.col("bad") / F.lit(float(max(bad, 1)))).alias("d0"))
    scores = spread(stage, start, edges, damping, close)
    per_page = F.col("distrust") * F.lit(float(bad)) - F.col("trust") * F.lit(float(good))
    hosts = scores.join(nodes.where("pages > 0").select("host", "pages"), "host").select("host", F.when(per_page / F.col("pages") > threshold, "block").otherwise("allow").alias("host_verdict"))
    out = spread_join(ruled, hosts, ["host"], F.struct("page_id", "path"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"))
