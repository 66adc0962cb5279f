"""URL filters: rules first, then trust and distrust spread over links between hosts, DataFrame functions only.

Hosts all or most of whose pages with a rule are allowed are trusted seeds, those blocked are blocked seeds. Trust is
a personalised PageRank from the trusted along links; distrust one from the blocked against them, as a host answers
for what it links to. A host is blocked if the distrust that links bring it is more than ``RATIO`` times the trust
they bring it; what it has as a seed doesn't count, so that a rule for one path says nothing about others.

Both take ``STEPS`` rounds, here and in the SQL, and are not carried on to their limit: a seed reaches hosts up to so
many links away. A host further than that from any blocked seed gets no distrust, and is allowed where the limit would
block it; where trust and distrust are close, the limit may decide otherwise.

Links are absolute addresses in href attributes; those within a host are left out, and a link counts once for each
pair of hosts. Each step is a join and a sum by host, combined before the shuffle; AQE splits hot hosts.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule and is allowed unless rules
say otherwise; a null page has no links; repeated pages give a row each; an empty table gives an empty result. Of
rules of one length that fit, the first listed wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, Store, fold_ascii

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, STEPS, RATIO = 0.85, 10, 1.0
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
MOST_BROADCAST = 500_000  # hosts


def parts(url):
    """(host, path) of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return fold_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _ordered(rules: tuple) -> list:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` with host, path, rule and ruling (the rule's verdict); null without a rule."""
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, of_host, of_path in reversed(_ordered(rules)):
        fits = ((F.col("host") == of_host) | F.endswith("host", F.lit(f".{of_host}"))) & F.startswith("path", F.lit(of_path))
        rule, ruling = F.when(fits, F.lit(of_host + of_path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return out.withColumn("rule", rule).withColumn("ruling", ruling)


def links(pages: DataFrame) -> DataFrame:
    """(src, dst) hosts, each pair once."""
    found = pages.where("host <> '' and contains(html, '//')").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    return found.select(F.col("host").alias("src"), fold_ascii(F.col("to")).alias("dst")).where("src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, store: Store, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, got): what ``seeds(host, share)`` bring each host along ``edges(src, dst)``, without its own share."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    weighed = store.keep(edges.join(out, "src").select("src", "dst", (F.lit(damping) / F.col("n")).alias("w")), "weighed")
    seeds = store.keep(seeds.select("host", ((1 - damping) * F.col("share")).alias("own")), "seeds")
    got = None
    for _ in range(steps):
        now = seeds.select("host", F.col("own").alias("rank"))
        if got is not None:
            now = now.unionByName(got.select("host", F.col("got").alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        made = weighed.join(now, F.col("src") == F.col("host")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        made = store.keep(made, "got")
        if got is not None:
            store.drop(got)
        got = made
    return got


def blocked_hosts(pages: DataFrame, store: Store) -> DataFrame:
    """Hosts that links bring more distrust than trust; of ``pages`` with host and ruling."""
    edges = store.keep(links(pages), "links")
    if edges.isEmpty():
        return edges.select(F.col("src").alias("blocked"))
    seeds = pages.where("ruling is not null").groupBy("host").agg(F.sum(F.when(F.col("ruling") == "allow", 1).otherwise(-1)).alias("n"))
    seeds = store.keep(seeds.where("n <> 0"), "rulings")
    number = seeds.groupBy((F.col("n") > 0).alias("good")).agg(F.count("*").alias("of"))
    shares = seeds.join(F.broadcast(number), (F.col("n") > 0) == F.col("good")).select("host", "good", (1.0 / F.col("of")).alias("share"))
    trust = spread(edges, shares.where("good"), store).select("host", F.col("got").alias("trust"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(back, shares.where("not good"), store).select("host", F.col("got").alias("distrust"))
    both = distrust.join(trust, "host", "left")
    return store.keep(both.where(F.col("distrust") > RATIO * F.coalesce("trust", F.lit(0.0))).select(F.col("host").alias("blocked")), "blocked")


def judged(pages: DataFrame, store: Store, rules: tuple = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    rows = ruled(pages.select("page_id", "url", "html"), rules)
    bad = blocked_hosts(rows, store)
    few = bad.count() <= MOST_BROADCAST
    out = rows.drop("html").join(F.broadcast(bad) if few else bad, F.col("host") == F.col("blocked"), "left")
    method = F.when(F.col("blocked").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"))


def sql() -> str:
    """The same in DuckDB's SQL, over table pages."""
    low = f"translate({{}}, '{UPPER}', '{LOWER}')"
    rest = "CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END"
    fits = lambda h, p: f"((host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}'))"
    case = lambda f: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{f(v, h, p)}'" for v, h, p in _ordered(RULES)) + " END"
    href = LINK.replace("'", "''")
    steps = []
    for name, edges, good in (("t", "edges", "n > 0"), ("d", "back", "n < 0")):
        steps.append(f"{name}s AS (SELECT host, {1 - DAMPING!r} / count(*) OVER () AS own FROM seeds WHERE {good})")
        steps.append(f"{name}w AS (SELECT src, dst, {DAMPING!r} / count(*) OVER (PARTITION BY src) AS w FROM {edges})")
        before = f"SELECT host, own AS rank FROM {name}s"
        for i in range(STEPS):
            now = before if not i else f"SELECT host, sum(rank) AS rank FROM ({before} UNION ALL SELECT host, got FROM {name}{i - 1}) GROUP BY host"
            steps.append(f"{name}{i} AS (SELECT dst AS host, sum(w * rank) AS got FROM {name}w JOIN ({now}) ON src = host GROUP BY dst)")
    return f"""
        WITH cut AS (SELECT page_id, html, coalesce({rest}, '') AS rest FROM pages),
        named AS (SELECT page_id, html, {low.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruling FROM named),
        found AS (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM ruled WHERE host <> ''),
        edges AS (SELECT DISTINCT host AS src, {low.format("link")} AS dst FROM found WHERE host <> {low.format("link")}),
        back AS (SELECT dst AS src, src AS dst FROM edges),
        seeds AS (SELECT host, sum(CASE WHEN ruling = 'allow' THEN 1 ELSE -1 END) AS n FROM ruled WHERE ruling IS NOT NULL GROUP BY host),
        {", ".join(steps)},
        bad AS (SELECT d.host FROM d{STEPS - 1} d LEFT JOIN t{STEPS - 1} t ON d.host = t.host WHERE d.got > {RATIO} * coalesce(t.got, 0.0))
        SELECT page_id, ruled.host, path, rule,
               coalesce(ruling, CASE WHEN ruled.host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
        FROM ruled"""
