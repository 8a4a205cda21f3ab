"""URL filters: rules first, then trust propagated over links between hosts.

Rules name a host and a path prefix; a rule fits its host and all subdomains
when the url's path starts with the rule's, and the longest fitting rule wins.

Pages that no rule fits are judged by their host. Hosts are nodes, links between different
hosts are edges weighted by their number. Trust is personalised PageRank along links
from hosts with more allowed than blocked pages; distrust is the same walk
along reversed links from hosts most of whose pages are blocked, since a page
that links to bad neighbours is suspect itself. Both start at the seeds in
proportion to the pages that made them seeds. A host is blocked when its
distrust exceeds ``threshold`` times its trust.
Hosts that neither walk reaches are allowed.

Both walks run together, as series: the mass that left the seeds k links ago is the k-th term, each step is one join
and one sum, and the series ends when a term holds less than ``tolerance`` of the seeds' mass, which bounds what is still
to come by ``tolerance / (1 - damping)``. Sums are scaled to 1, which is the PageRank in which mass of hosts without links returns to the seeds.

Host tables are written before they are joined, so that joins are plain ones of two shuffled tables, whose frequent hosts adaptive execution may
split.

Null urls, and urls without ``://``, have empty host and path and the method's
verdict for an unknown host (allow). Null html has no links. Repeated rows repeat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, session, written

ALLOW, BLOCK = "allow", "block"
#: Upper-case and lower-case letters that host names fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links that name their host, with or without a scheme.
LINK = r"""(?is)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def match_rules(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` (host + path of the longest that fits, else null) and ``ruled`` (its verdict)."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    host, path = F.col("host"), F.col("path")

    def pick(value) -> Column:
        return reduce(lambda rest, r: F.when(rule_fits(r, host, path), F.lit(value(r))).otherwise(rest), reversed(ranked), F.lit(None).cast("string"))

    return pages.withColumn("rule", pick(lambda r: r[1] + r[2])).withColumn("ruled", pick(lambda r: r[0]))


def walk(links: DataFrame, seeds: DataFrame, damping: float, tolerance: float, most_steps: int = 1000) -> DataFrame:
    """(kind, host, mass): personalised PageRank of each kind over links (kind, src, dst, share) from seeds (kind, host, seed)."""
    term = materialize(seeds.select("kind", "host", F.col("seed").alias("mass")), "mass", 4)
    terms = term
    for _ in range(most_steps):
        moved = term.join(links, (term.kind == links.kind) & (term.host == links.src)).groupBy(links.kind, F.col("dst").alias("host"))
        term = materialize(moved.agg((F.sum(F.col("mass") * F.col("share")) * damping).alias("mass")), "mass", 4)
        terms = terms.unionByName(term)
        if max((r.m for r in term.groupBy("kind").agg(F.sum("mass").alias("m")).collect()), default=0.0) < tolerance:
            break
    total = terms.groupBy("kind").agg(F.sum("mass").alias("total"))  # two rows at most
    mass = terms.groupBy("kind", "host").agg(F.sum("mass").alias("mass"))
    return mass.join(F.broadcast(total), "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass"))


def shares(edges: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    total = materialize(edges.groupBy(F.col(src).alias("_src")).agg(F.sum("n").alias("total")), "totals", 4)
    return edges.join(total, F.col(src) == F.col("_src")).select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("n") / F.col("total")).alias("share"))


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(a, b, n): links between different hosts."""
    links = pages.where(F.col("host") != "").select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), 1)).alias("url"))
    ends = links.select(F.col("host").alias("a"), host_of(F.regexp_replace("url", "^//", "http://")).alias("b")).where((F.col("b") != "") & (F.col("a") != F.col("b")))
    return ends.groupBy("a", "b").agg(F.count("*").alias("n"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, tolerance: float = 1e-4, threshold: float = 1.0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every row of ``pages``; rules: (allow or block, host, path prefix)."""
    spark, mark = session(pages), written()
    base = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("_html"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = match_rules(base, rules)
    edges = materialize(host_edges(base, "_html"), "edges", 4)
    slim = ruled.select("page_id", "host", "path", "rule", "ruled")
    linked = not edges.isEmpty()
    of = {v: F.count(F.when(F.col("ruled") == v, 1)) for v in (ALLOW, BLOCK)}
    counts = materialize(slim.where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("n"), of[ALLOW].alias(ALLOW), of[BLOCK].alias(BLOCK)), "seeds", 4)
    kinds = {ALLOW: (F.col(ALLOW) > F.col(BLOCK), "a", "b"), BLOCK: (2 * F.col(BLOCK) > F.col("n"), "b", "a")}
    seeds = [counts.where(is_seed).select(F.lit(kind).alias("kind"), "host", F.col(kind).cast("double").alias("seed")) for kind, (is_seed, _, _) in kinds.items()]
    seeds = seeds[0].unionByName(seeds[1])
    totals = {r.kind: r.total for r in seeds.groupBy("kind").agg(F.sum("seed").alias("total")).collect()}  # two rows at most
    share = F.coalesce(*[F.when(F.col("kind") == k, F.col("seed") / v) for k, v in totals.items()], F.lit(0.0))
    mass = seeds.select("kind", "host", share.alias("mass"))
    if linked:
        both = [shares(edges, src, dst, kind) for kind, (_, src, dst) in kinds.items()]
        links = materialize(both[0].unionByName(both[1]), "shares", 4)
        mass = walk(links, mass.withColumnRenamed("mass", "seed"), damping, tolerance)
    of = {kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0)) for kind in kinds}
    judged = materialize(mass.groupBy("host").agg(of[ALLOW].alias("trust"), of[BLOCK].alias("distrust")), "hosts", 4)
    discard(spark, mark, judged)
    out = slim.join(judged, "host", "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") > threshold * F.col("trust"), BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")
