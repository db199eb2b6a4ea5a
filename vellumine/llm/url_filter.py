"""URL filter: host rules first, then trust and distrust that spread over links between hosts.

`split_url` and `matching_rule` are plain expressions. `host_scores` runs a personalised PageRank from trusted hosts
along the links (a trusted host vouches for what it links to) and one from blocked hosts against the links (who links
to a blocked host is suspect), as joins and sums over host edges. A host whose distrust is at least `threshold` of its
trust and distrust together is blocked, if it has enough of it: at least `least` of what the blocked seed with the fewest
blocked pages starts with. So a single way of links to a blocked host tells only up to some length (28 links without any
branch at 0.01, fewer with branches), and a host beyond it, like one without any score, is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and gets the verdict of
the empty host, which is no node of the graph: allow. A null html has no links. Repeated rows are judged alike. An
empty table gives no rows. A page of any length is read whole by the JVM, one row at a time. Own columns are only those of
`keep`; others don't matter, whatever their names, but a column kept must not be named as one of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import lower_ascii, written

#: A host that is reached never scores less, however far away.
TINY = 1e-300
#: (verdict, host, path)
Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.substr(url, at + 3)
    known = url.isNotNull() & (at > 0)
    host = F.when(known, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))
    return host, path


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or nulls."""
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in by_length]
    pick = lambda value: F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, by_length, strict=True)], F.lit(None).cast("string"))
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def host_links(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """src, dst, links: absolute links between different hosts. Links without a host stay on their own."""
    found = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    return (
        pages.select(host.alias("src"), F.explode(F.array_distinct(F.transform(found, lower_ascii))).alias("dst"))
        .filter("src <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def _rank(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """Personalised PageRank: host, score. edges: src, dst, links; seeds: host, seed (sums to 1). Ends when a wave adds to no host more than
    `tolerance` of its score, so not before every host that can be reached has one; `rounds` ends it earlier where given."""
    out = edges.groupBy("src").agg(F.sum("links").alias("total"))
    weighted = written(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("total")).alias("share")), "host-edges")
    rank = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
    if weighted.isEmpty():
        return rank
    state = rank.withColumn("wave", F.col("score"))
    k = 0
    while rounds is None or k < rounds:  # the next power of the walk; what it adds shrinks by the damping each time
        moved = weighted.join(state.filter("wave > 0"), weighted["src"] == state["host"]).groupBy(F.col("dst").alias("host")).agg(F.greatest(damping * F.sum(F.col("share") * F.col("wave")), F.lit(TINY)).alias("score"))
        both = state.select("host", "score", F.lit(0.0).alias("wave")).unionByName(moved.withColumn("wave", F.col("score")))
        state = written(both.groupBy("host").agg(F.sum("score").alias("score"), F.sum("wave").alias("wave")), "host-wave")  # one row a host; cuts the lineage of the rounds
        k += 1
        if state.filter(F.col("wave") > F.greatest(tolerance * F.col("score"), F.lit(TINY))).isEmpty() and state.filter(F.col("wave") == F.col("score")).isEmpty():
            break
    return state.select("host", "score")


def host_scores(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """host, trust, distrust. seeds: host, allowed, blocked (numbers of pages that the rules decide)."""
    total = seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    share = seeds.join(F.broadcast(total)).select("host", *[F.coalesce(F.col(x) / F.nullif(F.col(y), F.lit(0)), F.lit(0.0)).alias(x) for x, y in (("allowed", "a"), ("blocked", "b"))])  # total is one row
    share = written(share, "host-seeds")
    trust = _rank(edges, share.filter("allowed > 0").select("host", F.col("allowed").alias("seed")), damping, rounds, tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    distrust = _rank(back, share.filter("blocked > 0").select("host", F.col("blocked").alias("seed")), damping, rounds, tolerance)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    return both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))


def judge_urls(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, least: float = 0.01, damping: float = 0.85, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """keep, host, path, rule, verdict, trust, distrust for each page. The rules decide where one fits, else the host's scores."""
    host, path = split_url(F.col(url))
    parts = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "said": said})
    seeds = ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    edges = written(host_links(pages, host, html), "host-links")
    start = seeds.filter("blocked > 0").agg(((1 - damping) * F.min("blocked") / F.sum("blocked")).alias("start"))  # one row
    scores = host_scores(edges, seeds, damping).join(F.broadcast(start)).select("host", "trust", "distrust", "start")
    judged = ruled.join(scores, "host", "left")
    bad = (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust"))) & (F.col("distrust") >= least * F.col("start"))
    method = F.when(bad, "block").otherwise("allow")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return judged.select(*keep, "host", "path", "rule", F.coalesce("said", method).alias("verdict"), zero("trust"), zero("distrust"))
