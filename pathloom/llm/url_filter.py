"""URL filters: path-template trees per host, judged by smoothed labelled purity. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import discard, spread_join, written

#: (verdict, host, path); the longest that fits wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A node whose children are at least so many, with fewer rows each than this, has a variable segment.
MANY_CHILDREN, FEW_ROWS = 8, 3.0
#: Branches whose shares of blocked and of allowed rows both differ by less than this (chi-square, 1 degree) are merged.
SIMILAR = 3.84
#: A template with blocked rows is rejected from this smoothed purity on: (blocked + 2 p) / (labelled + 2), p being that
#: of its host, (blocked + 1) / (labelled + 2).
PURITY = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://`` and for null."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _differs(k: Column, n: Column, all_k: Column, all_n: Column) -> Column:
    """Chi-square of a branch's share against that of its siblings; 0 where there are none or all agree."""
    rest_k, rest_n = (all_k - k).cast("double"), F.nullif((all_n - n).cast("double"), F.lit(0.0))
    pool = all_k / all_n
    gap = k / n - rest_k / rest_n
    spread = pool * (F.lit(1.0) - pool) * (F.lit(1.0) / n + F.lit(1.0) / rest_n)
    return F.coalesce(gap * gap / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def _level(rows: DataFrame, depth: int, total: int) -> DataFrame:
    """Grow every template by its segment at ``depth``, kept as it is or generalised to ``*``.

    Sums of children and nodes meet their rows by ``spread_join``, so neither a hot host nor a hot branch is a task.
    """
    here = rows.withColumn("segment", F.regexp_replace(F.get("segments", F.lit(depth - 1)), "[0-9]+", "<n>"))
    child = written(here.groupBy("host", "template", "segment").agg(
        F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), F.count(F.lit(1)).alias("paths")
    ))
    node = written(child.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("children"), F.sum("n").alias("node_n"), F.sum("blocked").alias("node_b"), F.sum("allowed").alias("node_a")
    ).withColumn("weight", F.col("children")))
    judged = spread_join(child, node, ["host", "template"], "weight", total)
    variable = (F.col("children") >= MANY_CHILDREN) & (F.col("node_n") / F.col("children") < FEW_ROWS)
    alike = (
        (F.col("children") > 1)
        & (_differs(F.col("blocked"), F.col("n"), F.col("node_b"), F.col("node_n")) < SIMILAR)
        & (_differs(F.col("allowed"), F.col("n"), F.col("node_a"), F.col("node_n")) < SIMILAR)
    )
    label = written(judged.select("host", "template", "segment", F.when(variable | alike, F.lit("*")).otherwise(F.col("segment")).alias("label"), "paths").withColumn("lone", (F.col("paths") == 1) & (F.col("label") == F.col("segment"))))
    grown = written(spread_join(here, label, ["host", "template", "segment"], "paths", total).withColumn("template", F.concat("template", F.lit("/"), "label")).drop("segment", "label"))
    discard(child, node, label)
    return grown


def templates(paths: DataFrame) -> DataFrame:
    """``paths(host, path, n, blocked, allowed)``, one row per host and path, with the ``template`` of each.

    From the root down, digits become ``<n>``, segments of nodes with many rare children become ``*``, and so do
    branches whose labelled shares do not differ from their siblings'. Paths that have ended, and those that are the
    only one of their node, leave the loop: a lone path keeps its other segments. So there is a round for each level
    that different paths share, and no limit of depth.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    live = written(paths.withColumn("segments", segments).withColumn("template", F.lit("")).withColumn("lone", F.lit(False)))
    total, depth, done = live.count(), 0, []
    while True:
        ended = F.col("lone") | (F.size("segments") <= depth)
        others = F.transform(F.slice("segments", F.lit(depth + 1), F.greatest(F.size("segments") - depth, F.lit(0))), lambda s: F.concat(F.lit("/"), F.regexp_replace(s, "[0-9]+", "<n>")))
        final = live.filter(ended).withColumn("template", F.concat("template", F.array_join(others, "")))
        done.append(final.select("host", "path", "n", "blocked", "allowed", "template"))
        live = live.filter(~ended)
        if not live.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        depth += 1
        live = _level(live.drop("lone"), depth, total)


def judge(pages: DataFrame, rules=RULES, purity: float = PURITY, seen: Column | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, tree_verdict`` for every row of ``pages(page_id, url)``.

    A rule that fits decides; it also labels its URL for the tree, where ``seen`` (a condition on host and path, by
    default all) is true. Other URLs get the tree's verdict, which stands in ``tree_verdict`` for all: blocked if the
    template of their path is, that is if it has blocked rows and the purity of its labelled rows, smoothed by that of
    the host, is at or above ``purity``. Hosts and templates without labels are allowed. Null and malformed urls have empty host and path; repeated rows
    are judged alike. Of rules of equal length that fit, the later one in the list decides. An empty table gives no
    rows; extra columns are ignored. Paths of any length and depth are used whole.
    """
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    per = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")))
    taught = F.when(F.lit(True) if seen is None else seen, ruled)
    counts = per.withColumn("__v", taught).select(
        "host", "path", "n", F.when(F.col("__v") == "block", F.col("n")).otherwise(0).alias("blocked"), F.when(F.col("__v") == "allow", F.col("n")).otherwise(0).alias("allowed")
    )
    tree = written(templates(counts))
    n_paths, n_rows = tree.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), F.count(F.lit(1)).alias("paths"))
    sums = written(sums)
    hosts = sums.groupBy("host").agg(F.sum("blocked").alias("host_b"), F.sum("allowed").alias("host_a"), F.count(F.lit(1)).alias("templates"))
    prior = (F.col("host_b") + F.lit(1.0)) / (F.col("host_b") + F.col("host_a") + F.lit(2.0))
    share = (F.col("blocked") + prior * F.lit(2.0)) / (F.col("blocked") + F.col("allowed") + F.lit(2.0))
    bad = (F.col("blocked") > 0) & (share >= F.lit(purity))
    known = spread_join(sums, written(hosts), ["host"], "templates", n_paths).select("host", "template", bad.alias("bad"), "paths")
    judged = spread_join(tree.select("host", "path", "template", "n"), written(known), ["host", "template"], "paths", n_paths)
    out = spread_join(rows, written(judged), ["host", "path"], "n", n_rows).withColumn("rule", rule)
    found = F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("__v", ruled).select("page_id", "host", "path", "rule", F.coalesce(F.col("__v"), found).alias("verdict"), "template", found.alias("tree_verdict"))


def _op3(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("tree_verdict")


def _sql() -> str:
    """The same judgement in DuckDB SQL, a round of a recursive table for each level."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{{i}}}" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
    )
    rule = "CASE " + fits.format(*[f"'{h}{p}'" for _, h, p in RULES]) + " END"
    ruled = "CASE " + fits.format(*[f"'{v}'" for v, _, _ in RULES]) + " END"
    parts = [
        f"""u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        f"r AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM u)",
        """t0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (ruled = 'block') AS blocked, count(*) FILTER (ruled = 'allow') AS allowed,
 list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template FROM r GROUP BY host, path)""",
    ]

    def differs(k: str) -> str:
        spread = f"((s_{k} / s_n) * (1.0 - (s_{k} / s_n)) * (1.0 / c_n + 1.0 / (s_n - c_n)::DOUBLE))"
        gap = f"(c_{k} / c_n - (s_{k} - c_{k})::DOUBLE / (s_n - c_n)::DOUBLE)"
        return f"CASE WHEN s_n - c_n > 0 AND {spread} > 0 THEN {gap} * {gap} / {spread} ELSE 0.0 END"

    node, child = "PARTITION BY host, template", "PARTITION BY host, template, segment"
    sums = ", ".join(
        f"sum({c}) OVER ({child}) AS c_{c}, sum({c}) FILTER (segment IS NOT NULL) OVER ({node}) AS s_{c}" for c in ("n", "blocked", "allowed")
    )
    parts += [
        f"""t AS (SELECT 0 AS d, * FROM t0 UNION ALL
SELECT d + 1, host, path, n, blocked, allowed, segments, CASE WHEN segment IS NULL THEN template ELSE template || '/' ||
 CASE WHEN children >= {MANY_CHILDREN} AND s_n / children < {FEW_ROWS} OR children > 1 AND {differs('blocked')} < {SIMILAR} AND {differs('allowed')} < {SIMILAR} THEN '*' ELSE segment END END
FROM (SELECT *, count(DISTINCT segment) OVER ({node}) AS children, {sums}
 FROM (SELECT *, regexp_replace(segments[d + 1], '[0-9]+', '<n>', 'g') AS segment FROM t WHERE d < (SELECT max(len(segments)) FROM t0))))""",
        "z AS (SELECT * FROM t WHERE d = (SELECT max(len(segments)) FROM t0))",
        "e AS (SELECT host, template, sum(blocked) AS b, sum(allowed) AS a FROM z GROUP BY ALL)",
        f"""s AS (SELECT host, template, b > 0 AND (b + (sum(b) OVER (PARTITION BY host) + 1.0) / (sum(b + a) OVER (PARTITION BY host) + 2.0) * 2.0) / (b + a + 2.0) >= {PURITY} AS bad
 FROM e)""",
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + """
SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict, z.template
FROM r JOIN z ON z.host = r.host AND z.path = r.path JOIN s ON s.host = z.host AND s.template = z.template"""


QUERIES = {"op3_url_filter": _op3}
ORACLE_SQL = {"op3_url_filter": _sql()}
