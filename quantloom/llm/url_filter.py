"""URL filtering by a tree of path templates.

A url's path is a sequence of segments under its host.  Level by level, down to the deepest path, a segment stays literal
in its branch if it has enough pages of its own, however many the branch has; the others are one wildcard.  A branch whose
labelled rate doesn't differ from that of the rest of its parent, by a two-proportion test, is merged into the parent, and
so on up to the host.  A template is rejected where the smoothed share of bad labels among the pages that it is merged
with reaches a threshold.  Fixed rules come before the templates.

All of it is grouped sums: the tree's tables hold a row for each branch, never a host's pages.

A null url, or one without `://`, has an empty host and path.  Repeated rows count as often as they occur.  Rows without
a page_id are judged too.  Extra columns are ignored.  Without labels nothing is rejected.  `page_labels` makes weak labels
page by page, from a page's own text and the words of its whole url, so that they differ between the branches of a host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs


@dataclass(frozen=True)
class Rule:
    """A verdict for the urls of a host and its subdomains whose path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
#: What of a page isn't its text: comments, elements that aren't read, and tags; one that isn't closed goes to the end.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|nav|template|noscript)\b.*?(?:</\1\s*+>|\z)|<[^>]*+>?"
#: Shares of words with a sign of none of a language's, above which a text is junk, and with a letter, below which it is.
SIGNS, LETTERS = 0.1, 0.8
#: A segment stays literal with at least this many pages, labelled or not.
SUPPORT = 5
#: |z| up to which a branch's rate is its parent's.
SIMILAR = 1.96
#: Pages that the overall rate counts for in a template's rate, and the rate at which it is rejected.
WEIGHT, REJECT = 10.0, 0.6


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    after = F.when(url.contains("://"), F.substring_index(F.concat(F.lit("x"), url), "://", 1))
    rest = F.when(url.contains("://"), F.substring(url, F.length(after) + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def junk(html: Column) -> Column:
    """Whether a page's visible text is junk by its words; null without words."""
    text = F.regexp_replace(html, HIDDEN, " ")
    count = lambda word: F.regexp_count(text, F.lit(r"(?<!\S)" + word))
    n = F.nullif(count(r"\S"), F.lit(0))
    return (count(r"[^\s|#$%*=_~^{}]*+[|#$%*=_~^{}]") / n > SIGNS) | (count(r"[^\s\p{L}]*+\p{L}") / n < LETTERS)


def page_labels(pages: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """page_id and bad of the pages (page_id, url, html): 1 if their url has one of the words or their text is junk, null if neither can be told."""
    host, path = host_path(F.col("url"))
    spoken = F.lit(False)
    for w in words:
        spoken = spoken | F.contains(F.concat(host, F.lower(path)), F.lit(w))
    return pages.select("page_id", F.when(spoken, 1).otherwise(junk(F.col("html")).cast("int")).alias("bad"))


def _segments(path: Column) -> Column:
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    return F.when(F.length(path) < 2, F.array().cast("array<string>")).otherwise(parts)


def templates(pages: DataFrame, support: int = SUPPORT) -> DataFrame:
    """The rows of pages (host, path, bad: 0, 1 or null) with `template`.

    One pass a level over the paths that are that deep: segments are counted by branch, and those that stay literal are
    joined back.
    """
    rows = jobs.stored(pages.withColumn("_s", _segments(F.col("path"))).withColumn("template", F.lit("")), "templates")
    done = rows.filter(F.size("_s") == 0)
    rows = rows.filter(F.size("_s") > 0)
    level = 0
    while not rows.isEmpty():
        seg = F.get("_s", F.lit(level))
        literal = rows.groupBy("host", "template", seg.alias("_seg")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= support).select("host", "template", "_seg", F.lit(True).alias("_keep"))
        rows = rows.withColumn("_seg", seg).join(literal, ["host", "template", "_seg"], "left")
        step = F.concat("template", F.lit("/"), F.when(F.col("_keep"), F.col("_seg")).otherwise(F.lit("*")))
        rows = jobs.stored(rows.withColumn("template", step).select(*done.columns), "templates")
        level += 1
        done = done.unionByName(rows.filter(F.size("_s") == level))
        rows = rows.filter(F.size("_s") > level)
    return done.drop("_s")


def purity(rows: DataFrame, similar: float = SIMILAR, weight: float = WEIGHT) -> DataFrame:
    """host, template, the branch that it is merged into, and the smoothed share of bad labels there.

    A template's branches are its first segments, from none (the host) to all; it is merged into the deepest of them that
    differs from the rest of its parent.
    """
    leaves = jobs.stored(rows.groupBy("host", "template").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")), "branches")
    parts = F.when(F.col("template") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("template", 2, 1 << 30), "/", -1))
    first = lambda j: F.when(j > 0, F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), j), "/"))).otherwise(F.lit(""))
    chains = leaves.withColumn("parts", parts).withColumn("j", F.explode(F.sequence(F.lit(0), F.size("parts")))).withColumn("node", first(F.col("j")))
    chains = chains.withColumn("up", F.when(F.col("j") > 0, first(F.col("j") - 1)))
    nodes = jobs.stored(chains.groupBy("host", "node", "up").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "nodes")
    parents = nodes.select("host", F.col("node").alias("up"), F.col("n").alias("pn"), F.col("k").alias("pk"))
    both = nodes.join(parents, ["host", "up"])
    rest_n, rest_k = F.col("pn") - F.col("n"), F.col("pk") - F.col("k")
    pooled = F.col("pk") / F.nullif(F.col("pn"), F.lit(0))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.nullif(F.col("n"), F.lit(0)) + 1 / F.nullif(rest_n, F.lit(0))))
    z = (F.col("k") / F.nullif(F.col("n"), F.lit(0)) - rest_k / F.nullif(rest_n, F.lit(0))) / F.nullif(spread, F.lit(0.0))
    apart = both.filter(F.coalesce(F.abs(z) > similar, F.lit(False))).select("host", "node", F.lit(True).alias("apart"))
    deepest = F.coalesce(F.max_by(F.when(F.col("apart"), F.col("node")), F.when(F.col("apart"), F.col("j"))), F.lit(""))
    merged = jobs.stored(chains.join(apart, ["host", "node"], "left").groupBy("host", "template", "n", "k").agg(deepest.alias("branch")), "merged")
    totals = merged.groupBy("host", "branch").agg(F.sum("n").alias("mn"), F.sum("k").alias("mk"))
    total = leaves.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    base = total.k / total.n if total.n else 0.0
    return merged.join(totals, ["host", "branch"]).select("host", "template", "branch", ((F.col("mk") + weight * base) / (F.col("mn") + weight)).alias("bad_share"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, and the template, branch and share behind it.

    pages: page_id, url.  labels: page_id, bad (0 or 1).
    """
    host, path = host_path(F.col("url"))
    one = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).join(one, "page_id", "left")
    rows = templates(rows)
    judged = rows.join(purity(rows), ["host", "template"], "left")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") >= reject, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "branch", F.round("bad_share", 6).alias("bad_share"))
