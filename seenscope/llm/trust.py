"""URL filtering by rules and by trust that spreads over the host graph.

Rules judge the URLs they fit, the longest one first. Hosts of allowed URLs are trusted seeds,
hosts of blocked ones distrusted seeds, each in proportion to its URLs. Trust is personalised
PageRank along links, distrust the same along reversed links: who links to blocked hosts is
suspect. A host whose distrust exceeds its trust is blocked, for URLs that no rule fits.

Edges are links of pages to other hosts, counted per pair of hosts, and one edge either way
between a host and its parent domain (down to two labels), as they are run together. Both
scores of all hosts take one join and one aggregation a round, with one shuffle of the ranks;
the edges are dealt once for several rounds, after which ranks are written.
Everything is DataFrame functions. Hot hosts only meet aggregations with map-side combine and
joins that adaptive execution can split. The mass of hosts without edges is not passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.plans.materialize import materialize

DAMPING = 0.85
ROUNDS = 10
WRITE_EVERY = 5  # rounds between two written tables of ranks
# The SQL twin drops scores below this; the operator keeps all, as seeds shrink with the table.
LEAST = 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
# (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _fitting(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(host, rules)`` for hosts with a rule; the rules from the longest to the shortest."""
    spark = hosts.sparkSession
    table = spark.range(1).select(
        F.explode(
            F.array(*[F.struct(F.lit(h).alias("domain"), F.lit(p).alias("rule_path"), F.lit(v).alias("verdict")) for h, p, v in rules])
        ).alias("r")
    )
    rule = F.struct(
        (-F.length(F.concat("domain", "rule_path"))).alias("order"),
        F.concat("domain", "rule_path").alias("rule"),
        "rule_path",
        "verdict",
    )
    return (
        hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
        .join(table.select("r.*"), "domain")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b, n)``: how many links of pages of host ``a`` lead to another host ``b``."""
    target = F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LINK), F.lit(1)))
    found = pages.select(host_of(F.col(url)).alias("a"), target.alias("b"))
    found = found.select("a", F.translate("b", UPPER, LOWER).alias("b"))
    return found.where("a != '' AND b != '' AND a != b").groupBy("a", "b").agg(F.count("*").alias("n"))


def _with_parents(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """Edges either way between every host and its parent domain, added to ``edges``."""
    every = hosts.select("host").union(edges.select("b"))
    domains = every.select(F.explode(suffixes(F.col("host"))).alias("host")).distinct()
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, 2, F.size(labels)), ".")
    child = domains.where(F.size(labels) > 2).select(F.col("host").alias("a"), parent.alias("b"))
    both = child.union(child.select("b", "a")).withColumn("n", F.lit(1).cast("long"))
    return edges.union(both).groupBy("a", "b").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """``(host, trust, distrust)`` from ``seeds(host, allowed, blocked)``.

    Without allowed (or blocked) seeds, trust (or distrust) is 0 for all hosts.
    """
    flows = edges.select(F.lit("trust").alias("kind"), F.col("a").alias("host"), F.col("b").alias("to"), "n").union(
        edges.select(F.lit("distrust"), "b", "a", "n")
    )
    out = flows.groupBy("kind", "host").agg(F.sum("n").alias("out"))
    share = (F.col("n") / F.col("out")).alias("share")
    flows = flows.join(out, ["kind", "host"]).select("kind", "host", "to", share)
    total = lambda c: seeds.agg(F.sum(c)).scalar()
    start = seeds.select(F.lit("trust").alias("kind"), "host", F.try_divide(F.col("allowed").cast("double"), total("allowed")).alias("seed")).union(
        seeds.select(F.lit("distrust"), "host", F.try_divide(F.col("blocked").cast("double"), total("blocked")))
    )
    start = start.where("seed > 0")
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    for i in range(rounds):
        moved = ranks.join(flows, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        back = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
        ranks = moved.union(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % WRITE_EVERY == 0:
            ranks = materialize(ranks, "ranks")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    A null URL, or one without ``://``, has an empty host, fits no rule, has neither trust nor
    distrust and is allowed. Null pages have no links; rows may repeat; further columns are
    ignored; an empty table gives an empty result.
    """
    parsed = pages.select(
        F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    )
    hosts = parsed.select("host").distinct()
    fitting = hosts.join(_fitting(hosts, rules), "host", "left")
    chosen = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    ruled = parsed.join(fitting, "host").withColumn("chosen", chosen)
    votes = lambda v, name: F.count_if(F.col("chosen.verdict") == v).alias(name)
    seeds = ruled.where("host != ''").groupBy("host").agg(votes("allow", "allowed"), votes("block", "blocked"))
    edges = _with_parents(links(pages, url, html), hosts.where("host != ''"))
    scores = spread(materialize(edges, "edges"), materialize(seeds, "host-votes"))
    scored = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")]
    judged = fitting.join(scores, "host", "left").select("host", "rules", *scored)
    method = F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow")
    return (
        parsed.join(judged, "host")
        .withColumn("chosen", chosen)
        .select(
            "page_id", "host", "path",
            F.col("chosen.rule").alias("rule"),
            F.coalesce("chosen.verdict", method).alias("verdict"),
            "trust", "distrust",
        )
    )
