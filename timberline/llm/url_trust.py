"""URL filter: rules on host and path, and link-graph propagation for what no rule names.

Trust starts at hosts with allowed pages and follows links; distrust starts at
hosts with blocked pages and follows links backwards. Both are personalised
PageRank over weighted host edges, run as joins and sums in Spark. A host whose
distrust exceeds its trust by the given factor is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import Scratch

_HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""

NAME = 253  # Fixed value: the characters of the longest domain name.
LEFT = 1e-4  # of the mass of all seeds, at most, is never spread
STEPS = 8  # links followed between written tables


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from there up to ``? #``; else both empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULLs if none does.

    A rule ``host/path`` fits its host and all subdomains if the path starts with
    its path. The list is a parameter and part of the plan; it does not grow with the pages.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) from the columns ``host`` and ``html``: links between hosts, summed.

    A host and each domain above it also count as linked with the next one up, both
    ways, once: what stands under one name has one owner. Names of one label are not
    hosts; what is longer than a domain name can be has no domain above it.
    """
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), 1)))
    # User name and port are no part of a host.
    target = F.regexp_replace(lower_ascii(F.col("link")), r"^.*@|:\d*$", "")
    links = pages.filter("host <> ''").select("host", found.alias("link")).select(F.col("host").alias("src"), target.alias("dst"))
    links = links.filter("src <> dst AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    names = pages.select("host").filter(F.col("host").contains(".") & (F.length("host") <= NAME)).distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    names = names.select(F.explode(above).alias("src")).distinct()
    up = names.select("src", F.expr("substring(src, instr(src, '.') + 1)").alias("dst")).filter("src NOT LIKE '.%' AND dst LIKE '_%.%' AND dst NOT LIKE '.%'")
    both = up.unionAll(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, left: float) -> DataFrame:
    """(host, side, score): personalised PageRank along (side, src, dst, w) from the seeds (host, side, score).

    The score is the sum over path lengths of what is left after each link, so a
    step touches only hosts reached; what a dead end holds is not passed on. Steps go
    on until what all further ones could add, over all hosts of a side, is at most ``left``.
    """
    out = edges.groupBy("side", "src").agg(F.sum("w").alias("total"))
    shares = edges.join(out, ["side", "src"]).select("side", F.col("src").alias("host"), "dst", (F.col("w") / F.col("total")).alias("share"))
    ends = edges.select("side", F.explode(F.array("src", "dst")).alias("host")).unionAll(seeds.select("side", "host")).distinct()
    # A row from each host to itself, of no share, keeps its score, so that a step is one join and one sum.
    shares = shares.unionAll(ends.select("side", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("share")))
    shares = scratch.keep(shares, "shares")
    mass = F.col("score") * (1 - damping)
    state, k = scratch.keep(seeds.select("host", "side", mass.alias("mass"), mass.alias("score")), "state-0"), 0
    # A side's mass never grows by more than the damping, so this ends.
    while any(r.mass * damping / (1 - damping) > left for r in state.groupBy("side").agg(F.sum("mass").alias("mass")).collect()):
        for _ in range(STEPS):
            moved = state.join(shares, ["host", "side"]).select(
                F.col("dst").alias("host"),
                "side",
                F.coalesce(F.col("mass") * F.col("share") * damping, F.lit(0.0)).alias("mass"),
                F.when(F.col("share").isNull(), F.col("score")).otherwise(F.col("mass") * F.col("share") * damping).alias("score"),
            )
            state = moved.groupBy("host", "side").agg(F.sum("mass").alias("mass"), F.sum("score").alias("score"))
        state, k = scratch.keep(state, f"state-{k + 1}"), k + 1
        scratch.drop(f"state-{k - 1}")
    scratch.drop("shares")
    return state.select("host", "side", "score")


def judge(
    pages: DataFrame,
    scratch: Scratch,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    left: float = LEFT,
    factor: float = 1.0,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page.

    ``rules`` holds ("allow" | "block", "host/path"). Pages no rule fits are judged
    by host, with ranks exact to ``left`` of the seeds' mass: block if distrust > factor * trust, else allow; so a host that nothing
    is known of is allowed. Seeds weigh by their pages that a rule allows or blocks.
    A null url, or one without ``://``, has empty host and path and is allowed; null
    html has no links. Repeated rows are judged alike; an empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.drop("html").withColumns({"rule": rule, "ruled": verdict})
    edges = scratch.keep(host_edges(parsed), "edges")
    votes = ruled.filter("ruled IS NOT NULL AND host <> ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")
    )
    votes = scratch.keep(votes, "votes")
    allowed, blocked = votes.agg(F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    # The larger side starts with a mass of 1 and the other in proportion.
    most = max(allowed, blocked, 1)
    good = votes.filter("allow > 0").select("host", F.lit("trust").alias("side"), (F.col("allow") / most).alias("score"))
    bad = votes.filter("block > 0").select("host", F.lit("distrust").alias("side"), (F.col("block") / most).alias("score"))
    back = edges.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = edges.select(F.lit("trust").alias("side"), "src", "dst", "w").unionAll(back)
    ranks = spread(both, good.unionAll(bad), scratch, damping, left)
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("score"))), F.lit(0.0)).alias(name)
    scores = scratch.keep(ranks.groupBy("host").agg(side("trust"), side("distrust")), "scores")
    # Sums of doubles depend on their order in the last digits; equal scores must stay equal.
    by_host = F.when(F.col("distrust") > factor * (1 + 1e-9) * F.col("trust"), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.join(scores, "host", "left").select(
        F.col("page").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
