"""URL filters by link-graph propagation.

Explicit rules decide the urls they fit. For the rest, trust and distrust flow over the host graph of the pages' links:
trust starts at hosts in proportion to their pages that rules allow and follows links forward; distrust starts in
proportion to pages that rules block and follows links backward (a page that points to a blocked host is suspect). Links
inside a host are edges to itself, and a host and its parent domain (``blog.a.org`` and ``a.org``), where both have
pages or links, count as linked once each way. Both are personalised PageRank vectors, iterated together in Spark until
they settle. A host is blocked where its distrust is above its trust times a threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.llm._common import read
from lexweave.plans.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links: the href of an element.
LINK = r"""(?is)<(?:a|area|link)\s[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as (name, verdict); null if none does."""
    longest_first = sorted(rules, key=lambda r: (-len(r.name), r.name))
    out = F.lit(None).cast("struct<name: string, verdict: string>")
    for r in reversed(longest_first):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: Column) -> DataFrame:
    """Distinct links between hosts, a host's own included, with their numbers: src, dst, n. A reference without a
    host stays on its own; one to a place on the page (``#``) or with another scheme (``mailto:``) is none."""
    href = F.col("link")
    target = (
        F.when(href.startswith("//"), host_of(F.concat(F.lit("x:"), href)))
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), host_of(href))
        .when(href.startswith("#"), F.lit(""))
        .otherwise(F.col("src"))
    )
    return (
        pages.select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
        .select("src", target.alias("dst"))
        .where("src <> '' and dst <> ''")
        .groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def parent_edges(hosts: DataFrame) -> DataFrame:
    """Links both ways between a host and the one that is left without its first label, if both are in ``hosts``."""
    child = hosts.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1).alias("dst")).where("dst <> ''")
    both = child.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    return both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1).cast("long"))


#: Edges in a partition while ranks are iterated; a graph of one partition needs no exchange.
PARTITION_EDGES = 500_000


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.5, tolerance: float = 1e-6, most_rounds: int = 500) -> DataFrame:
    """host, trust, distrust: personalised PageRank from ``seeds`` (host, good, bad), forward for good and backward
    for bad. What a host without links in a direction holds stays with it, so no mass is lost. Each round is one join
    with the edges and one partial aggregation; a link passes on ``damping`` of what its host holds; every fifth is checkpointed. Ends when a round moves less than
    ``tolerance`` in all, and raises an error if it never does."""
    both = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "n", F.lit(True).alias("forward")).unionByName(
        edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "n", F.lit(False).alias("forward"))
    )
    hosts = seeds.select("host").unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    out = both.groupBy("at", "forward").agg(F.sum("n").alias("total"))
    sides = hosts.select(F.col("host").alias("at"), F.explode(F.array(F.lit(True), F.lit(False))).alias("forward"))
    stuck = sides.join(out, ["at", "forward"], "left_anti").select("at", F.col("at").alias("to"), "forward", F.lit(1.0).alias("w"))
    weights = both.join(out, ["at", "forward"]).groupBy("at", "to", "forward").agg((F.sum("n") / F.first("total")).alias("w")).unionByName(stuck)
    partitions = max(1, -(-edges.count() // PARTITION_EDGES), -(-seeds.count() // PARTITION_EDGES))
    placed = lambda df, key: cut(df.coalesce(1) if partitions == 1 else df.repartition(partitions, key))
    weights = placed(weights, "at")
    total = float(seeds.agg(F.sum(F.col("good") + F.col("bad")).alias("n")).first()["n"] or 1)  # an allowed page weighs as much as a blocked one
    start = placed(hosts.join(seeds, "host", "left").select(
        "host", (F.coalesce("good", F.lit(0)) / total).alias("s_good"), (F.coalesce("bad", F.lit(0)) / total).alias("s_bad")
    ), "host")
    now = start.select("host", F.col("s_good").alias("trust"), F.col("s_bad").alias("distrust"))
    mixed = lambda seed, got: (1 - damping) * F.col(seed) + damping * F.coalesce(got, F.lit(0.0))
    for step in range(1, most_rounds + 1):
        sent = now.join(weights, F.col("host") == F.col("at")).groupBy("to").agg(
            F.sum(F.when(F.col("forward"), F.col("trust") * F.col("w"))).alias("in_trust"),
            F.sum(F.when(~F.col("forward"), F.col("distrust") * F.col("w"))).alias("in_distrust"),
        )
        new = start.join(sent, F.col("host") == F.col("to"), "left").select("host", mixed("s_good", "in_trust").alias("trust"), mixed("s_bad", "in_distrust").alias("distrust"))
        if step % 5:
            now = new
            continue
        before, now = now, cut(new)
        moved = now.join(before.withColumnsRenamed({"trust": "t", "distrust": "d"}), "host").agg(
            F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))).alias("x")
        ).first()["x"]
        if (moved or 0.0) < tolerance:
            return now
    raise RuntimeError(f"ranks did not settle in {most_rounds} rounds")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 1.0) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, trust, distrust.

    ``pages``: page_id, url, html. A url's rule, if one fits, decides; else its host is blocked if its distrust is
    above ``threshold`` times its trust. A host that neither reaches is allowed, and so is a url that is null or has
    no ``://`` (host and path are empty, and it takes no part in the graph). A null html has no links. Repeated
    rows and null page_ids give a row each and count each as a seed. Other columns are not read.
    """
    urls = pages.select("page_id", "url", "html")
    judged = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("r.name").alias("rule"), F.col("r.verdict").alias("given"))
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("given") == "allow").alias("good"), F.count_if(F.col("given") == "block").alias("bad"))
    seeds, links = cut(seeds), cut(host_edges(urls, host_of(F.col("url"))))
    hosts = seeds.select("host").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    ranks = propagate(seeds, links.unionByName(parent_edges(hosts)))
    out = judged.join(ranks, "host", "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > threshold * trust, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
