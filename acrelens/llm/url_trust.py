"""URL filter by rules and link-graph propagation; DataFrame functions only.

A page's url gives host and path. The longest rule that fits decides the page. Every
other page is decided by its host: links in the pages make weighted host edges, on
which personalised PageRank spreads trust along links from hosts with allowed pages,
and distrust against the links (to hosts that link there) from hosts with blocked
pages. Both start vectors sum to one. A host is blocked if distrust is more than
THRESHOLD of the two together, else allowed; a host that neither reaches is allowed.

A round is one join of the rank table with the transition table and one aggregate;
a host with very many links is summed by partial aggregation first. Weight that
reaches a host without links ends there. Ranks are written every few rounds; after
ROUNDS, more follow until no host is new and the last one moved less than MOVED of
either rank in all.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed. Null html has no links. A link names a host if it begins with a scheme
and ``://``, or with ``//`` (the page's own scheme). Relative links, whatever stands
in them, and links within a host don't count. Repeated rows come back repeated and count again. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelens.scratch import materialize

#: Rule (host/path) and verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
DAMPING = 0.85
ROUNDS = 20
ROUNDS_AT_ONCE = 5
MOVED = 1e-9
THRESHOLD = 0.5
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK_HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_LINK = "(?i)href\\s*=\\s*[\"']?([^\"'\\s>]+)"


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), upper, upper.lower())


def link_host_of(link: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(link, _LINK_HOST, 1), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule in sorted(rules, key=len, reverse=True):
        name, _, start = rule.partition("/")
        here = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        fits.append(F.when(here, rule))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def judged_by_rules(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict or null)."""
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(*[F.when(F.col("rule") == r, v) for r, v in rules.items()], F.lit(None).cast("string"))
    return out.withColumn("ruled", verdict)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): how many pages of src link to dst, another host."""
    hosts = F.transform(F.regexp_extract_all(F.col("html"), F.lit(_LINK), F.lit(1)), link_host_of)
    pairs = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(hosts)).alias("dst"))
    return pairs.filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, bound: float | None = None) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, weight) and seeds (host, trust, distrust).

    ``seeds`` are shares that sum to one in each column. With ``bound``, ``rounds``
    are the fewest: more follow until no host is new and the last moved less than it.
    """
    edges = materialize(edges, "host_edges")
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    along = edges.join(out, "src").select(F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("p"), F.lit(True).alias("forward"))
    against = edges.join(back, "dst").select(F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("weight") / F.col("total")).alias("p"), F.lit(False).alias("forward"))
    steps = materialize(along.unionByName(against), "transitions")
    start = materialize(seeds.select("host", *[((1 - damping) * F.col(c)).alias(c) for c in ("trust", "distrust")]), "seeds")
    ranks = before = start
    i = 0
    while True:
        i += 1
        flow = F.col("p") * damping
        moved = ranks.join(steps, F.col("host") == F.col("from")).select(
            F.col("to").alias("host"), F.when(F.col("forward"), F.col("trust") * flow).otherwise(0.0).alias("trust"), F.when(F.col("forward"), 0.0).otherwise(F.col("distrust") * flow).alias("distrust")
        )
        before, ranks = ranks, moved.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % ROUNDS_AT_ONCE == 0 or i >= rounds:
            ranks = materialize(ranks, "ranks")
        if i >= rounds and (bound is None or ((i - rounds) % ROUNDS_AT_ONCE == 0 and _settled(before, ranks, bound))):
            return ranks


def _settled(before: DataFrame, ranks: DataFrame, bound: float) -> bool:
    """Whether a round brought no new host to either rank and moved less than ``bound`` of both."""
    old = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
    both = ranks.join(old, "host", "left").na.fill(0.0)
    new = ((F.col("trust") > 0) & (F.col("t") == 0)) | ((F.col("distrust") > 0) & (F.col("d") == 0))
    change = both.agg(F.count_if(new).alias("new"), F.sum(F.abs(F.col("trust") - F.col("t"))).alias("trust"), F.sum(F.abs(F.col("distrust") - F.col("d"))).alias("distrust")).first()
    return change["new"] == 0 and max(change["trust"] or 0.0, change["distrust"] or 0.0) < bound


def judge_pages(pages: DataFrame, rules: dict[str, str] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    ruled = judged_by_rules(pages, rules)
    counts = materialize(ruled.filter("ruled is not null").groupBy("host").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b")), "host_counts")
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n or 1))).alias("trust" if c == "a" else "distrust")
    ranks = propagate(host_edges(pages), counts.select("host", share("a", total["a"]), share("b", total["b"])), damping, rounds, MOVED)
    blocked = ranks.filter(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select("host", F.lit("block").alias("by_host"))
    return ruled.join(blocked, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))


def oracle_sql() -> str:
    """The same by DuckDB, with ROUNDS rounds written out: enough where no host is further from a seed."""
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lambda u: low(f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")
    named = lambda link: low(f"regexp_extract({link}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)")
    fits = []
    for rule in sorted(RULES, key=len, reverse=True):
        name, _, start = rule.partition("/")
        fits.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{start}') THEN '{rule}'")
    verdicts = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items())
    steps = [
        f"parts AS MATERIALIZED (SELECT page_id, html, {host('url')} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)",
        f"matched AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM parts)",
        f"ruled AS MATERIALIZED (SELECT page_id, host, path, rule, CASE rule {verdicts} END AS ruled FROM matched)",
        "counts AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM ruled WHERE ruled IS NOT NULL GROUP BY host)",
        f"seeds AS MATERIALIZED (SELECT host, {1 - DAMPING} * a / greatest((SELECT sum(a) FROM counts), 1) AS trust, {1 - DAMPING} * b / greatest((SELECT sum(b) FROM counts), 1) AS distrust FROM counts)",
        "links AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']?([^\"''\\s>]+)', 1), lambda x: " + named("x") + "))) AS dst FROM parts)",
        "edges AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        "steps AS MATERIALIZED (SELECT src AS f, dst AS t, weight / sum(weight) OVER (PARTITION BY src) AS p, true AS forward FROM edges UNION ALL SELECT dst, src, weight / sum(weight) OVER (PARTITION BY dst), false FROM edges)",
        "r0 AS MATERIALIZED (SELECT * FROM seeds)",
    ]
    for i in range(ROUNDS):
        steps.append(
            f"r{i + 1} AS MATERIALIZED (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (SELECT t AS host, CASE WHEN forward THEN trust * p * {DAMPING} ELSE 0 END AS trust, CASE WHEN forward THEN 0 ELSE distrust * p * {DAMPING} END AS distrust FROM r{i} JOIN steps ON host = f UNION ALL SELECT * FROM seeds) GROUP BY host)"
        )
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust > {THRESHOLD} * (trust + distrust) THEN 'block' END, 'allow') AS verdict FROM ruled r LEFT JOIN r{ROUNDS} k ON r.host = k.host"
    )
