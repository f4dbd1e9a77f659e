"""URL filters: rules by host and path, and trust that spreads over the graph of hosts.

Rules decide what they fit. All other urls go by their host: personalised PageRank from hosts whose pages a rule allows (along the edges), the
same from hosts whose pages a rule blocks (against the edges, so that who links to a blocked host is distrusted), and a threshold on the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, cut, discard, fresh

#: Host and path of the rules of the query, and what they say.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"(?is)<(?:a|area)\s(?:[^>]*\s)?href\s*=\s*[\"']?([^\"'\s>]+)"
AWAY = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a wholly trusted or distrusted host starts with; sums of whole numbers don't depend on their order.
UNIT = 1_000_000_000
ROUNDS, DAMPING, THRESHOLD = 20, 85, 50


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules (host, path, verdict) of each host and of the domains above it, the longest first; equally long ones by host, path, verdict. Hosts without any are left out."""
    names = F.expr(r"transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    above = hosts.select("host", F.explode(names).alias("_domain"))
    fitting = above.join(rules.select(F.col("host").alias("_domain"), "path", "verdict").distinct(), "_domain")
    order = F.struct(-(F.length("_domain") + F.length("path")), -F.length("_domain"), F.concat("_domain", "path").alias("rule"), "path", "verdict")
    return fitting.groupBy("host").agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: F.struct(x["rule"].alias("rule"), x["path"].alias("path"), x["verdict"].alias("verdict"))).alias("rules"))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): hosts whose pages link to another host, and how many links do; links without a host stay in their own and are no edge."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("_href"))
    away = found.select("src", F.translate(F.regexp_extract("_href", AWAY, 1), UPPER, LOWER).alias("dst"))
    return away.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def kin(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): edges both ways between each host and the domain above it, and on up to names of two labels; every edge has weight 1."""
    labels = F.size(F.split("host", "[.]"))
    chain = F.expr("transform(sequence(2, greatest(size(split(host, '[.]')), 2)), i -> substring_index(host, '.', -i))")
    pairs = hosts.filter((F.col("host") != "") & (labels > 2)).select(chain.alias("_c")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_c") - 1), lambda i: F.struct(F.element_at("_c", i + 1).alias("src"), F.element_at("_c", i).alias("dst")))).alias("_p")).select("_p.*").distinct()
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1).cast("long"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: int = DAMPING, written_every: int = 5) -> DataFrame:
    """(host, trust, distrust) of hosts that have either, after ``rounds`` steps of personalised PageRank.

    ``edges``: src, dst, weight (several rows of one edge add up). ``seeds``: host (unique), trust, distrust (whole numbers). Each step a host keeps
    (100 - ``damping``) % of its seed and passes ``damping`` % of what it has along its edges, in parts by weight, rounded down; distrust goes from dst to src.
    Edges that share a hub are split by Spark's skew join, as the other side has one row per host. No edges: seeds are all there is. No seeds: no rows.
    """
    summed = cut(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "summed")
    both = summed.select(F.lit(0).alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "weight").union(summed.select(F.lit(1), F.col("dst"), F.col("src"), F.col("weight")))
    out = both.groupBy("kind", "at").agg(F.sum("weight").alias("_all"))
    shares = cut(both.join(out, ["kind", "at"]).select("kind", "at", "to", (F.col("weight").cast("double") / F.col("_all").cast("double")).alias("share")), "edges")
    start = cut(seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("host").alias("at"), F.col("trust").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("host").alias("at"), F.col("distrust").alias("value")))).alias("_s")).select("_s.*").filter("value > 0"), "seeds")
    now, old = start, []
    for step in range(1, rounds + 1):
        passed = now.join(shares, ["kind", "at"]).select("kind", F.col("to").alias("at"), F.floor(F.col("value").cast("double") * F.col("share")).cast("long").alias("value"), F.lit(0).cast("long").alias("seed"))
        parts = passed.union(start.select("kind", "at", F.lit(0).cast("long"), F.col("value")))
        now = parts.groupBy("kind", "at").agg(F.expr(f"({damping} * sum(value) + {100 - damping} * sum(seed)) div 100").alias("value")).filter("value > 0")
        if step % written_every == 0 or step == rounds:
            now = cut(now, "ranks")
            discard(*old)
            old = [now]
    wide = now.groupBy(F.col("at").alias("host")).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("value"))), F.lit(0)).alias(c) for k, c in enumerate(("trust", "distrust"))))
    return wide


def judge(pages: DataFrame, rules: DataFrame, keep: tuple[str, ...] = ("page_id",), domains: bool = True, rounds: int = ROUNDS, damping: int = DAMPING, threshold: int = THRESHOLD) -> DataFrame:
    """Every row of ``pages`` (url, html) with the columns ``keep`` and a struct ``verdict`` (longer by underscores if taken): host, path, rule, verdict, trust, distrust.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all below it where the path starts with the rule's; the longest wins. A
    host's seeds are the shares of its pages that rules allow and block. Where no rule fits, a page is blocked if its host has distrust, and that is at
    least ``threshold`` % of trust and distrust together; hosts that neither reaches are allowed. ``domains`` adds edges between a host and the domain above it.

    Null url, or one without ``://``: host and path are empty, which no rule fits and no edge touches, so they are allowed. Null html: no links. Repeated
    rows are judged one by one, alike, and each counts in its host's shares; other columns don't matter; no rows give none.
    """
    out = fresh(pages.select(*keep), "verdict")
    host, path, fits, weight = (fresh(pages.select(*keep), c) for c in ("_host", "_path", "_fits", "_pages"))
    parsed = pages.select(*keep, host_of(F.col("url")).alias(host), path_of(F.col("url")).alias(path))
    hosts = cut(parsed.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n")), "hosts")
    fitting = hosts.join(rules_of_hosts(hosts, rules), "host", "left").select(F.col("host").alias(host), F.col("n").alias(weight), F.col("rules").alias(fits))
    ruled = attach(parsed, fitting, host, weight)
    said = F.get(F.filter(F.col(fits), lambda r: F.col(path).startswith(r["path"])), F.lit(0))
    ruled = cut(ruled.select(*keep, host, path, said.alias(fits)), "ruled")
    count_of = lambda verdict: F.count(F.when(F.col(f"{fits}.verdict") == verdict, 1))
    seeds = ruled.filter(F.col(host) != "").groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("_all"), count_of("allow").alias("_allow"), count_of("block").alias("_block"))
    seeds = seeds.select("host", F.expr(f"{UNIT}L * _allow div _all").alias("trust"), F.expr(f"{UNIT}L * _block div _all").alias("distrust"))
    edges = cut(links(pages), "links")
    if domains:
        edges = edges.union(kin(hosts.select("host").union(edges.select("dst")).distinct()))
    scores = spread(edges, seeds, rounds, damping)
    known = hosts.join(scores, "host", "left").select(F.col("host").alias(host), F.col("n").alias(weight), *(F.coalesce(c, F.lit(0)).alias(f"{fits}_{c}") for c in ("trust", "distrust")))
    rated = attach(ruled, known, host, weight)
    trust, distrust = F.col(f"{fits}_trust"), F.col(f"{fits}_distrust")
    by_host = F.when((distrust > 0) & (100 * distrust >= threshold * (trust + distrust)), "block").otherwise("allow")
    return rated.select(*keep, F.struct(F.col(host).alias("host"), F.col(path).alias("path"), F.col(f"{fits}.rule").alias("rule"), F.coalesce(F.col(f"{fits}.verdict"), by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")).alias(out))


def digest(pages: DataFrame) -> DataFrame:
    """The query's columns under its rules: page_id, host, path, rule, verdict, trust, distrust."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(pages, rules).select("page_id", "verdict.*")


def _sql() -> str:
    """The query in SQL: the steps of the propagation one after the other."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    steps = "".join(f""", r{i} AS MATERIALIZED (
  SELECT kind, spot, ({DAMPING} * sum(value) + {100 - DAMPING} * sum(seed)) // 100 AS value FROM (
    SELECT s.kind, s.target AS spot, CAST(floor(CAST(r.value AS DOUBLE) * s.share) AS HUGEINT) AS value, 0 AS seed FROM r{i - 1} r JOIN shares s ON s.kind = r.kind AND s.spot = r.spot
    UNION ALL SELECT kind, spot, 0, value FROM r0
  ) GROUP BY kind, spot HAVING ({DAMPING} * sum(value) + {100 - DAMPING} * sum(seed)) // 100 > 0)""" for i in range(1, ROUNDS + 1))
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return f"""
WITH rules(h, p, v) AS (VALUES {listed}), parsed AS MATERIALIZED (
  SELECT row_number() OVER () AS id, page_id, html, {lower(f"coalesce(regexp_extract(url, '{PARTS}', 1), '')")} AS host, coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path FROM pages
), ruled AS MATERIALIZED (
  SELECT d.id, d.page_id, d.host, d.path, m.rule, m.v FROM parsed d LEFT JOIN (
    SELECT p0.id, h || p AS rule, v FROM parsed p0 JOIN rules ON (p0.host = h OR ends_with(p0.host, '.' || h)) AND starts_with(p0.path, p)
    QUALIFY row_number() OVER (PARTITION BY p0.id ORDER BY length(h || p) DESC, length(h) DESC) = 1
  ) m ON m.id = d.id
), seeds AS (
  SELECT host, {UNIT} * count(*) FILTER (v = 'allow') // count(*) AS trust, {UNIT} * count(*) FILTER (v = 'block') // count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host
), hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '{HREF.replace("'", "''")}', 1)) AS href FROM parsed),
linked AS (
  SELECT src, dst, count(*) AS weight FROM (SELECT src, {lower(f"regexp_extract(href, '{AWAY}', 1)")} AS dst FROM hrefs) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), named AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM (SELECT host FROM parsed UNION ALL SELECT dst FROM linked) WHERE host <> '' AND len(string_split(host, '.')) > 2),
pairs AS (SELECT DISTINCT array_to_string(l[i:], '.') AS a, array_to_string(l[i + 1:], '.') AS b FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM named)),
edges AS MATERIALIZED (
  SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM linked UNION ALL SELECT a, b, 1 FROM pairs UNION ALL SELECT b, a, 1 FROM pairs) GROUP BY src, dst
), both_ways AS (SELECT 0 AS kind, src AS spot, dst AS target, weight FROM edges UNION ALL SELECT 1, dst, src, weight FROM edges),
shares AS MATERIALIZED (SELECT kind, spot, target, CAST(weight AS DOUBLE) / CAST(sum(weight) OVER (PARTITION BY kind, spot) AS DOUBLE) AS share FROM both_ways),
r0 AS MATERIALIZED (SELECT 0 AS kind, host AS spot, trust AS value FROM seeds WHERE trust > 0 UNION ALL SELECT 1, host, distrust FROM seeds WHERE distrust > 0){steps},
scores AS (SELECT spot AS host, coalesce(sum(value) FILTER (kind = 0), 0) AS trust, coalesce(sum(value) FILTER (kind = 1), 0) AS distrust FROM r{ROUNDS} GROUP BY spot)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN coalesce(distrust, 0) > 0 AND 100 * distrust >= {THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(trust, 0) AS BIGINT) AS trust, CAST(coalesce(distrust, 0) AS BIGINT) AS distrust
FROM ruled LEFT JOIN scores USING (host)
"""


JUDGE_SQL = _sql()
