"""URL filters: rules by host and path, and trust spread over the links between hosts.

The longest rule that fits a url decides. Where none fits, the host decides: trust is
spread from trusted hosts along links (personalised PageRank), distrust from blocked hosts
against them, since a host that links to blocked ones is suspect, not one that is linked
by them. A host is blocked if its distrust exceeds its trust and ``least`` as well.

A walk divides the score of a host among all that link to it, so that each linker of a popular blocked host gets
next to nothing. Both scores are therefore also taken as means over a host's own links, out for distrust and in
for trust, which do not shrink with the number of linkers, and a host is blocked by either pair.

A seed is a host of which rules allow, or block, more than half the pages or, if it has no page in the table, more
than half the different urls that are linked. A url without a path counts as one of ``/`` there. In the graph
a host is its name without user and port, for pages and links alike. Links within a host are no edges. The mass of hosts without edges is not dealt anew.

Defined results: a null url, or one without ``://``, has an empty host and path; a null html has no
links; rows that repeat count as pages of their own; an empty table gives no rows; other
columns are not carried.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrilake.llm.scratch import Scratch
from sentrilake.session import cut

#: (verdict, rule)
RULES: tuple[tuple[str, str], ...] = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
DAMPING = 0.85
LEAST = 0.01
#: A round leaves 0.85 of the mass moving: 1e-6 of the total is reached after 85 rounds.
ROUNDS = 200
TOLERANCE = 1e-6
_LINK = "(?i)\\bhref\\s*=\\s*[\"']?\\s*(?:https?:)?(//[^/?#\"'\\s<>]+[^?#\"'\\s<>]*)"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are configuration: one condition each."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(host, "^.*@|:\\d*$", "")


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts of ``pages`` (host, html): source, target, the linked host and path, n."""
    links = pages.select(name_of(F.col("host")).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
    url = F.concat(F.lit(":"), "link")
    links = links.select("source", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("target", name_of(F.col("host")))
    links = links.where("target != '' AND source != '' AND target != source")
    return links.groupBy("source", "target", "host", "path").agg(F.count("*").alias("n"))


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts of ``pages`` (host, html): source, target, n."""
    return _edges(host_links(pages))


def _edges(links: DataFrame) -> DataFrame:
    return links.groupBy("source", "target").agg(F.sum("n").alias("n"))


def _kinds(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``urls`` (host, path) to name and kind: trust, distrust or null. Rules may name a port; others fit any."""
    path = F.when(F.col("path") == "", "/").otherwise(F.col("path"))
    said = F.coalesce(rule_of(F.col("host"), path, rules)[1], rule_of(name_of(F.col("host")), path, rules)[1])
    rows = urls.select(name_of(F.col("host")).alias("name"), said.alias("said")).where("name != ''")
    counts = rows.groupBy("name").agg(
        F.count("*").alias("n"), F.count_if(F.col("said") == "allow").alias("allowed"),
        F.count_if(F.col("said") == "block").alias("blocked"),
    )
    kind = F.when(2 * F.col("allowed") > F.col("n"), "trust").when(2 * F.col("blocked") > F.col("n"), "distrust")
    return counts.select("name", kind.alias("kind"))


def seeds_of(rows: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(host, kind) of the hosts that rules trust or distrust: by their pages in ``rows`` (host, path), or
    by the linked urls if they have none."""
    crawled = _kinds(rows, rules)
    linked = _kinds(links.select("host", "path").distinct(), rules)
    linked = linked.join(crawled.select(F.col("name").alias("crawled")), F.col("name") == F.col("crawled"), "left_anti")
    return crawled.unionByName(linked).where("kind IS NOT NULL").withColumnRenamed("name", "host")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS,
              tolerance: float = TOLERANCE) -> DataFrame:
    """``edges`` (source, target, n) and ``seeds`` (host, kind) to scores (host, kind, score).

    trust walks the edges and distrust the reversed ones; each host deals its score to the next ones by the
    number of links. trust_mean and distrust_mean go the same ways, but each host takes the mean
    of the scores of those before it. All kinds of ``seeds`` run in the same rounds. A round is one join and one
    sum over hosts; it is written, so that lineage stays short. It ends when the last round moved at most ``tolerance``
    of the total of each kind, and fails if ``rounds`` do not get there; tolerance 0 asks for just that many rounds."""
    def walk(kind: str, host: str, to: str, per: str) -> DataFrame:
        return edges.select(F.lit(kind).alias("kind"), F.col(host).alias("host"), F.col(to).alias("to"), F.col(per).alias("per"), "n")

    walks = walk("trust", "source", "target", "source").unionByName(walk("distrust", "target", "source", "target")).unionByName(
        walk("trust_mean", "source", "target", "target")).unionByName(walk("distrust_mean", "target", "source", "source"))
    out = walks.groupBy("kind", "per").agg(F.sum("n").alias("all_n"))
    with Scratch(edges.sparkSession) as scratch:
        walks = scratch.cut(walks.join(out, ["kind", "per"]).select("kind", "host", "to", (F.col("n") / F.col("all_n")).alias("share")))
        base = scratch.cut(seeds.select("kind", "host", F.lit(1 - damping).alias("score")))
        scores, totals, change = base, _totals(base), 0.0
        for _ in range(rounds):
            moved = scores.join(walks, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            new = scratch.cut(moved.unionByName(base).groupBy("kind", "host").agg(F.sum("score").alias("score")))
            if scores is not base:
                scratch.drop(scores)
            # Scores only ever grow towards their limits, so the totals say how far they still are.
            scores, earlier, totals = new, totals, _totals(new)
            change = max((1 - earlier[kind] / total for kind, total in totals.items()), default=0.0)
            # The order of a sum alone moves a total by some 1e-16 of it.
            if change <= max(tolerance, 1e-15):
                break
        if change > tolerance > 0:
            raise RuntimeError(f"{rounds} rounds leave a change of {change:.1e} of the total, above {tolerance:.1e}")
        return cut(scores)


def _totals(scores: DataFrame) -> dict[str, float]:
    return dict(scores.groupBy("kind").agg(F.sum("score")).collect())  # one row per kind


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, least: float = LEAST,
               damping: float = DAMPING) -> DataFrame:
    """``pages`` (page_id, url, html) to page_id, host, path, rule, verdict, trust, distrust."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": verdict})
    links = cut(host_links(pages.select(host_of(F.col("url")).alias("host"), "html")))
    seeds = cut(seeds_of(rows, links, rules))
    edges = cut(_edges(links))
    both = seeds.unionByName(seeds.withColumn("kind", F.concat("kind", F.lit("_mean"))))
    scores = propagate(edges, both, damping)
    kinds = ["trust", "distrust", "trust_mean", "distrust_mean"]
    hosts = cut(scores.groupBy(F.col("host").alias("known_host")).agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0)).alias(kind) for kind in kinds]))
    rows = rows.withColumn("name", name_of(F.col("host")))
    joined = rows.join(hosts, F.col("name") == F.col("known_host"), "left").drop("known_host", "name").fillna(0.0, kinds)
    suspect = ((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least)) | (
        (F.col("distrust_mean") > F.col("trust_mean")) & (F.col("distrust_mean") >= least))
    verdict = F.coalesce("said", F.when(suspect, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
