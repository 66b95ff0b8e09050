"""URL filter rules, then trust and distrust over the host graph (operator 10).

Rules decide the urls they fit.  The hosts of allowed pages are trusted seeds, the hosts
of blocked pages distrusted ones.  Personalised PageRank carries trust along host edges, and distrust
against them (who links to a blocked host is suspect); a host whose distrust exceeds its
trust is blocked.  Steps are taken until no score changes by more than a millionth of itself, so
every host that a seed reaches has its score, however far it is and however small its share.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import Hot, fresh, stored

DAMPING = 0.85
#: Scores are final when none changes by more than this share of itself; more rounds than the bound are an error.
TOLERANCE = 1e-6
MOST_ROUNDS = 2000
#: Steps between two written tables, and edges that are worth a task.
CHAIN, TASK_EDGES = 6, 500_000
#: Distrust must exceed trust by this share: far more than what is left open, so that equal scores are equal.
MARGIN = 1e-4
#: As many rules become one expression; more are joined as a table.
MOST_INLINE = 100

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute or scheme-relative link.
LINK = r"""(?i)href\s{0,8}=\s{0,8}["']?(?:[a-z][a-z0-9+.-]{0,15}:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def by_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls, as one expression."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        here = fits(host, path, rule)
        name = F.when(here, rule.name).otherwise(name)
        verdict = F.when(here, rule.verdict).otherwise(verdict)
    return name, verdict


def with_rule(rows: DataFrame, rules: list[Rule], inline: int = MOST_INLINE) -> DataFrame:
    """``rows(host, path, ...)`` with ``rule`` and ``ruled``: the longest rule that fits and its verdict, else nulls.

    More than ``inline`` rules are a table that the host and the domains above it are joined with; a row
    meets as many as its host has labels, and only the longest that fits is kept.
    """
    if len(rules) <= inline:
        rule, ruled = by_rule(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "ruled": ruled})
    spark, key = rows.sparkSession, fresh(rows.columns, "row_no")
    held = stored(rows.withColumn(key, F.monotonically_increasing_id()), "ruled-rows")
    table = spark.createDataFrame([(r.host, r.path, r.verdict, r.name) for r in rules], "domain STRING, start STRING, ruled STRING, rule STRING")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = held.select(key, "path", F.explode(above).alias("domain"))
    met = Hot(asked, "domain").join(asked, table, key).where(F.startswith("path", "start"))
    best = met.groupBy(key).agg(F.max(F.struct(F.length("rule").alias("size"), "rule", "ruled")).alias("best"))
    return held.join(best, key, "left").withColumns({"rule": F.col("best.rule"), "ruled": F.col("best.ruled")}).drop(key, "best")


def parent(host: Column) -> Column:
    """The host without its first label, where at least two labels remain; else null."""
    return F.when(F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) >= 2, F.expr("substr(host, instr(host, '.') + 1)"))


def host_graph(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Distinct edges (src, dst) between different hosts: links of the pages, and a host with the domain above it, both ways."""
    found = F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)))
    linked = (pages.where(F.col("html").isNotNull() & F.contains("html", F.lit("//"))).select("host", found.alias("dst"))
              .select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst")))
    up = hosts.select(F.col("host").alias("src"), parent(F.col("host")).alias("dst")).where("dst IS NOT NULL")
    edges = linked.union(up).union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where("src != dst AND src != '' AND dst != ''").distinct()


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from ``seeds(host, trust, distrust)``, whose columns add up to one or to nothing.

    Trust goes from src to dst, distrust from dst to src, each an equal share to every neighbour.
    A host that no seed reaches has no row.  A kind and a host are one key (``node``), and edges of a node that
    holds many are dealt over tasks.
    """
    node = lambda kind, host: F.concat(F.lit(f"{kind}:"), F.col(host))
    ways = edges.select(node("trust", "src").alias("node"), node("trust", "dst").alias("dst")).union(
        edges.select(node("distrust", "dst").alias("node"), node("distrust", "src").alias("dst")))
    fan = ways.groupBy("node").agg(F.count("*").alias("fan"))
    hot = Hot(ways, "node")
    ways = stored(hot.join(ways, fan, "dst"), "host-edges")
    start = stored(seeds.select(F.explode(F.array(F.struct(node("trust", "host").alias("node"), F.col("trust").alias("seed")),
                                                  F.struct(node("distrust", "host").alias("node"), F.col("distrust").alias("seed")))).alias("s"))
                   .select("s.*").where("seed > 0"), "host-seeds")
    # Tasks by the size of the graph: a step over few edges is not worth the cluster's number of partitions.
    tasks = 1 + ways.count() // TASK_EDGES
    scores = start.select("node", F.col("seed").alias("score"))
    for _ in range(0, MOST_ROUNDS, CHAIN):
        before = None
        for _ in range(CHAIN):
            before = scores
            passed = hot.join(ways, scores, "dst").select(F.col("dst").alias("node"), (DAMPING * F.col("score") / F.col("fan")).alias("score"))
            back = start.select("node", ((1 - DAMPING) * F.col("seed")).alias("score"))
            scores = passed.union(back).groupBy("node").agg(F.sum("score").alias("score")).coalesce(tasks)
        # The last step next to the one before it; a host that is reached anew had nothing.
        change = F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))) / F.col("score")
        held = stored(scores.join(before.select("node", F.col("score").alias("was")), "node", "left").select("node", "score", change.alias("change")).coalesce(tasks), "host-scores")
        scores = held.select("node", "score")
        if held.where(F.col("change") > TOLERANCE).isEmpty():
            break
    else:
        raise RuntimeError(f"host scores still change after {MOST_ROUNDS} rounds")
    host, kind = F.expr("substr(node, instr(node, ':') + 1)"), F.expr("substr(node, 1, instr(node, ':') - 1)")
    of = lambda name: F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("score"))), F.lit(0.0))
    return scores.select(host.alias("host"), kind.alias("kind"), "score").groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], inline: int = MOST_INLINE) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict, trust, distrust.

    Without a rule a page is blocked where its host's distrust exceeds its trust (by more than ``MARGIN`` of it), else
    allowed; pages without a host, and hosts that no score reaches, are allowed.  A null url has
    neither host nor path, a null html no links.  Repeated rows and ids stay rows of their own and count
    as often as seeds; other columns are left alone; an empty table gives no row.
    """
    host, path = parts(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), "html", host.alias("host"), path.alias("path"))
    named = with_rule(split, rules, inline)
    hosts = stored(named.where("host != ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")), "hosts")
    sums = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    share = lambda c: F.col(c) / F.lit(float(sums[c] or 1))
    seeds = hosts.select("host", share("allowed").alias("trust"), share("blocked").alias("distrust"))
    scores = propagate(host_graph(named, hosts), seeds)
    rows, none = named.drop("html"), F.lit(0.0)
    return (Hot(rows, "host").join(rows, scores, "page_id", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("distrust") > F.col("trust") * (1 + MARGIN), "block").otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", none).alias("trust"), F.coalesce("distrust", none).alias("distrust")))


def sql(rules: list[Rule], rounds: int = 250) -> str:
    """The same in DuckDB's SQL over the table ``pages``, without the scores: steps until what is left is beyond a double's digits."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fit = lambda r: f"((host = {text(r.host)} OR ends_with(host, {text('.' + r.host)})) AND starts_with(path, {text(r.path)}))"
    case = lambda f: "CASE " + " ".join(f"WHEN {fit(r)} THEN {text(f(r))}" for r in longest) + " END"
    return f"""
WITH RECURSIVE cut AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] END AS rest FROM pages),
split AS (SELECT page_id, html,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
named AS MATERIALIZED (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS ruled FROM split),
hosts AS MATERIALIZED (SELECT host, count(*) FILTER (ruled = 'allow') AS allowed, count(*) FILTER (ruled = 'block') AS blocked
    FROM named WHERE host != '' GROUP BY host),
up AS (SELECT host AS src, host[strpos(host, '.') + 1:] AS dst FROM hosts WHERE length(host) - length(replace(host, '.', '')) >= 2),
edges AS MATERIALIZED (SELECT DISTINCT src, dst FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, {text(LINK)}, 1)), '{UPPER}', '{LOWER}') AS dst FROM named
    UNION ALL SELECT src, dst FROM up UNION ALL SELECT dst, src FROM up) WHERE src != dst AND src != '' AND dst != ''),
both_ways AS (SELECT 'trust' AS kind, src, dst FROM edges UNION ALL SELECT 'distrust', dst, src FROM edges),
ways AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, src) AS fan FROM both_ways),
sums AS (SELECT greatest(sum(allowed), 1)::DOUBLE AS allowed, greatest(sum(blocked), 1)::DOUBLE AS blocked FROM hosts),
seeds AS MATERIALIZED (SELECT 'trust' AS kind, host, h.allowed / sums.allowed AS seed FROM hosts h, sums
    UNION ALL SELECT 'distrust', host, h.blocked / sums.blocked FROM hosts h, sums),
s(k, kind, host, score) AS (
    SELECT 0, kind, host, seed::DOUBLE FROM seeds
    UNION ALL
    SELECT k, kind, host, sum(score) FROM (
        SELECT s.k + 1 AS k, w.kind, w.dst AS host, {DAMPING} * s.score / w.fan AS score FROM s JOIN ways w ON w.src = s.host AND w.kind = s.kind WHERE s.k < {rounds}
        UNION ALL SELECT l.k + 1, x.kind, x.host, {1 - DAMPING} * x.seed FROM (SELECT max(k) AS k FROM s HAVING max(k) < {rounds}) l, seeds x) GROUP BY ALL),
final AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust,
    coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM s WHERE k = {rounds} GROUP BY host)
SELECT page_id, n.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust * (1 + {MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN final f ON n.host = f.host"""
