"""URL filters: rules, and link-graph propagation for hosts that no rule judges.

Hosts are nodes and links between different hosts are weighted edges. Trust flows from hosts whose
pages the rules allow along links (personalised PageRank); distrust flows from hosts whose pages the
rules block against the links. A host with more distrust than trust, by a factor, is blocked. All of
it is DataFrame operations; pages are reduced to host pairs before anything iterates.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and gets
the method's verdict of the empty host; null html has no links; repeated rows each get their verdict;
an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Fixed values: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rounds of the oracle, and of ``spread`` unless told otherwise; the query iterates until scores settle.
ROUNDS, DAMPING = 8, 0.85
#: Scores have settled when none has grown by more than this part of itself over EVERY rounds; a host just reached has grown by all of its score.
TOLERANCE, EVERY = 1e-9, 4
#: Least score of a reached host: shares multiplied along many links must not become zero.
LEAST = 1e-300
#: A host is blocked if its distrust is over RATIO times its trust.
RATIO = 1.0
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, prefix in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last to fit is the longest
        name, _, rest = prefix.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def located(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled."""
    url = F.coalesce(F.col("url"), F.lit(""))
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: pages of src that link to another host dst."""
    host = host_of(F.coalesce(F.col("url"), F.lit("")))
    links = F.regexp_extract_all("html", F.lit(LINK), 1)
    absolute = F.filter(F.transform(links, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)), lambda x: x.contains("://"))
    targets = F.array_distinct(F.transform(absolute, host_of))
    edges = pages.where(F.col("html").isNotNull()).select(host.alias("src"), F.explode(targets).alias("dst")).where("src <> dst")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(seeds: DataFrame, edges: DataFrame, rounds: int | None = ROUNDS, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank: seeds (host, mass) to (host, score) after ``rounds`` rounds over edges (src, dst, links), or when scores have settled if that is None."""
    out = edges.groupBy("src").agg(F.sum("links").alias("out"))
    flow = cut(edges.join(out, "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share")))
    start = seeds.select("host", ((1 - damping) * F.col("mass")).alias("score"))
    score = last = start
    if flow.isEmpty():  # nothing flows, in any round
        return start
    done = 0
    while rounds is None or done < rounds:
        moved = flow.join(score, flow["src"] == score["host"]).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
        score = start.unionByName(moved).groupBy("host").agg(F.greatest(F.sum("score"), F.lit(LEAST)).alias("score"))
        done += 1
        if done % EVERY == 0:
            score = cut(score)
            if rounds is None:
                both = score.join(last.select("host", F.col("score").alias("before")), "host", "left")
                grown = both.agg(F.max(1 - F.coalesce("before", F.lit(0.0)) / F.col("score"))).first()[0]
                if grown is None or grown <= tolerance:
                    return score
                last = score
    return score


def host_scores(pages: DataFrame, rules=RULES, rounds: int | None = None, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust of hosts that have any of either."""
    votes = F.coalesce(F.sum((F.col("ruled") == "allow").cast("int") - (F.col("ruled") == "block").cast("int")), F.lit(0))
    seeds = cut(located(pages, rules).where(F.col("ruled").isNotNull()).groupBy("host").agg(votes.cast("double").alias("votes")))
    edges = cut(host_edges(pages))
    total = seeds.agg(F.sum(F.greatest("votes", F.lit(0.0))).alias("for"), F.sum(F.greatest(-F.col("votes"), F.lit(0.0))).alias("against")).first()
    trusted = seeds.where("votes > 0").select("host", (F.col("votes") / (total["for"] or 1.0)).alias("mass"))
    blocked = seeds.where("votes < 0").select("host", (-F.col("votes") / (total["against"] or 1.0)).alias("mass"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = spread(trusted, edges, rounds, damping).withColumnRenamed("score", "trust")
    distrust = spread(blocked, back, rounds, damping).withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])


def judge(pages: DataFrame, rules=RULES, rounds: int | None = None, damping: float = DAMPING, ratio: float = RATIO) -> DataFrame:
    bad = host_scores(pages, rules, rounds, damping).where(F.col("distrust") > ratio * F.col("trust")).select("host", F.lit(True).alias("bad"))
    method = F.when(F.col("bad"), "block").otherwise("allow")
    return located(pages, rules).join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def op2(pages: DataFrame) -> DataFrame:
    return judge(pages)


def _sql_spread(name: str, seeds: str, src: str, dst: str) -> str:
    steps = [f"{name}_flow AS (SELECT {src} AS src, {dst} AS dst, links / sum(links) OVER (PARTITION BY {src}) AS share FROM edges)", f"{name}0 AS (SELECT host, 0.15::DOUBLE * mass AS score FROM {seeds})"]
    steps += [
        f"{name}{k} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}0 UNION ALL SELECT dst, 0.85 * share * score FROM {name}_flow JOIN {name}{k - 1} ON src = host) GROUP BY host)"
        for k in range(1, ROUNDS + 1)
    ]
    return ",\n".join(steps)


_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
_CASES = [(what, prefix, _FITS.format(h=prefix.partition("/")[0], p=prefix.partition("/")[2])) for what, prefix in sorted(RULES, key=lambda r: (-len(r[1]), r[1]))]
ORACLE_SQL = rf"""
WITH urls AS (
  SELECT page_id, html, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls
), judged AS (
  SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{prefix}'" for _, prefix, fits in _CASES)} END AS rule,
         CASE {" ".join(f"WHEN {fits} THEN '{what}'" for what, _, fits in _CASES)} END AS ruled FROM parts
), links AS (
  SELECT page_id, host AS src, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS link FROM parts WHERE html IS NOT NULL
), targets AS (
  SELECT DISTINCT page_id, src, translate(regexp_extract(CASE WHEN link LIKE '//%' THEN 'http:' || link ELSE link END, '://([^/?#]*)', 1),
         '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS dst FROM links WHERE link LIKE '//%' OR contains(link, '://')
), edges AS (SELECT src, dst, count(*)::DOUBLE AS links FROM targets WHERE src <> dst GROUP BY src, dst
), votes AS (SELECT host, sum((ruled = 'allow')::INT - (ruled = 'block')::INT)::DOUBLE AS votes FROM judged WHERE ruled IS NOT NULL GROUP BY host
), trusted AS (SELECT host, votes / sum(votes) OVER () AS mass FROM votes WHERE votes > 0
), blocked AS (SELECT host, votes / sum(votes) OVER () AS mass FROM votes WHERE votes < 0),
{_sql_spread("t", "trusted", "src", "dst")},
{_sql_spread("d", "blocked", "dst", "src")}
SELECT page_id, j.host, path, rule, coalesce(ruled, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN t{ROUNDS} t ON t.host = j.host LEFT JOIN d{ROUNDS} d ON d.host = j.host
"""
