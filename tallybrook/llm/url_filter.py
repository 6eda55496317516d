"""URL filters: rules first, then a tree of path templates judged by their labelled purity.

Method, per host and level of the path: a segment stays literal if it recurs below its parent, else it
becomes a wildcard of its shape. It recurs with one in `MAX_BRANCHES` of the urls there or more, on all
hosts together and `MIN_REPEATS` times, or on its own host, if its segments there come `MIN_REPEATS`
times each on average. Levels grow until no value of a level is frequent enough to be a literal. Labelled
sibling branches whose rates do not differ significantly from their pooled rate are merged; a branch
without labels is evidence of nothing and stays. A template is rejected if its rate of bad labels
exceeds one half, smoothed by its path's rate on all hosts and that by the rates down the tree, from
the root's to that of the path's first levels, if any of these but the root has a label. The urls that a
rule decides are the labelled examples; the templates carry their verdicts over to the others.

Cases: a null url, or one without `://`, has an empty host and path and is judged as such; a null or
repeated id makes rows of its own, and repeated urls count as often as they come; ties in purity (exactly
one half) allow; an empty table gives an empty result; further columns are ignored. Each level that has
a frequent value costs a round of joins, so a path repeated at great depth costs rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybrook.llm.common import LOWER, UPPER, ascii_lower, salted_left_join, staged

MAX_BRANCHES = 50  # literal segments below one parent
MIN_REPEATS = 4  # of a literal segment
SMOOTHING = 10  # labelled examples that a prior counts for
CRITICAL = 3.8416  # square of 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def by_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; rules are (verdict, `host/path`)."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        hit = fits(host, path, name, f"/{rest}")
        found, verdict = F.when(hit, rule).otherwise(found), F.when(hit, kind).otherwise(verdict)
    return found, verdict


def shape(segment: Column) -> Column:
    return F.when(segment.rlike("[0-9]"), F.regexp_replace(segment, "[0-9]+", "{n}")).otherwise("{w}")


def _literals(seen: DataFrame) -> DataFrame:
    """The (host, parent, value) of `seen` that stay literal."""
    n, total = F.col("n"), F.col("total")
    counts = seen.groupBy("host", "parent", "value").agg(F.count("*").alias("n"))
    own = counts.groupBy("host", "parent").agg(F.sum("n").alias("total"), F.count("*").alias("values"))
    pooled = counts.groupBy("parent", "value").agg(F.sum("n").alias("n"))
    everywhere = salted_left_join(pooled.where(n >= MIN_REPEATS), pooled.groupBy("parent").agg(F.sum("n").alias("total")), ["parent"])
    everywhere = everywhere.where(n * MAX_BRANCHES >= total).select("parent", "value", F.lit(True).alias("common"))
    joined = salted_left_join(salted_left_join(counts, own, ["host", "parent"]), everywhere, ["parent", "value"])
    recurs = (total >= MIN_REPEATS * F.col("values")) & (n * MAX_BRANCHES >= total)
    return joined.where(recurs | F.col("common")).select("host", "parent", "value", F.lit(True).alias("literal"))


def _generalised(urls: DataFrame, level: int) -> DataFrame:
    """Add the template of one more level to `template`, an array of node names."""
    rows = urls.withColumn("value", F.get("segments", F.lit(level))).withColumn("parent", F.concat_ws("/", "template"))
    name = F.when(F.col("literal"), F.col("value")).otherwise(shape(F.col("value")))
    grown = F.when(F.col("value").isNull(), F.col("template")).otherwise(F.concat("template", F.array(name)))
    joined = salted_left_join(rows, _literals(rows.where("value is not null")), ["host", "parent", "value"])
    return joined.withColumn("template", grown).drop("value", "parent", "literal")


def literal_levels(urls: DataFrame) -> int:
    """How many levels from the root on may have literals: below, no value comes often enough at its level."""
    values = urls.select(F.posexplode("segments").alias("level", "value")).groupBy("level", "value").count()
    return (values.where(F.col("count") >= MIN_REPEATS).agg(F.max("level") + 1).first()[0]) or 0


def template_tree(urls: DataFrame, levels: int) -> DataFrame:
    """Replace `segments` by `template`: an array of literals and wildcards."""
    urls = urls.withColumn("template", F.array().cast("array<string>"))
    for level in range(levels):
        urls = staged(_generalised(urls, level), f"url-level-{level}")
    below = F.transform(F.filter("segments", lambda s, i: i >= levels), shape)
    return urls.withColumn("template", F.concat("template", below)).drop("segments")


def _merged(templates: DataFrame, level: int) -> DataFrame:
    """Replace node `level` of `merged` by `*` where the branch's labelled rate is like its siblings'."""
    node = F.get("merged", F.lit(level))
    literal = F.coalesce(~node.contains("{") & (node != "*"), F.lit(False))
    general = F.transform("merged", lambda x, i: F.when(i == level, F.lit("*")).otherwise(x))
    branch = templates.withColumn("general", F.when(literal, F.concat_ws("/", general)))
    own = branch.where("general is not null").groupBy("host", "general", "merged").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where("n > 0")
    pooled = own.groupBy("host", "general").agg(F.sum("n").alias("pool_n"), F.sum("bad").alias("pool_bad"), F.count("*").alias("branches"))
    n, bad, pool_n, pool_bad = (F.col(c).cast("double") for c in ("n", "bad", "pool_n", "pool_bad"))
    alike = (bad * pool_n - n * pool_bad) * (bad * pool_n - n * pool_bad) <= F.lit(CRITICAL) * n * pool_bad * (pool_n - pool_bad)
    similar = own.join(pooled, ["host", "general"]).where(alike & (F.col("branches") > 1)).select("host", "merged", F.lit(True).alias("similar"))
    return (
        branch.drop("general")
        .join(similar, ["host", "merged"], "left")
        .withColumn("merged", F.when(F.col("similar"), general).otherwise(F.col("merged")))
        .drop("similar")
    )


def _smoothed(bad: Column, n: Column, prior: Column) -> Column:
    return (bad + SMOOTHING * prior) / (n + SMOOTHING)


def path_rates(templates: DataFrame, levels: int) -> DataFrame:
    """The rate of each merged path on all hosts, and whether it or a node above it, but the root, has labels."""
    paths = templates.groupBy("merged").agg(F.sum("n").alias("path_n"), F.sum("bad").alias("path_bad"))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size("merged"), F.lit(levels))), lambda k: F.struct(k.alias("level"), F.slice("merged", F.lit(1), k).alias("prefix"))
    )
    nodes = paths.select("merged", "path_n", "path_bad", F.inline(prefixes))
    counts = nodes.groupBy("level", "prefix").agg(F.sum("path_n").alias("n"), F.sum("path_bad").alias("bad"))
    chains = salted_left_join(nodes, counts, ["level", "prefix"]).groupBy("merged", "path_n", "path_bad")
    chains = chains.agg(F.sort_array(F.collect_list(F.struct("level", "n", "bad"))).alias("nodes"))  # one a level
    root = F.get("nodes", F.lit(0))
    base = F.when(root["n"] > 0, root["bad"] / root["n"]).otherwise(0.0)
    below = F.filter("nodes", lambda x: x["level"] > 0)
    rate = F.aggregate(below, base, lambda prior, x: _smoothed(x["bad"], x["n"], prior))
    known = (F.col("path_n") > 0) | F.exists(below, lambda x: x["n"] > 0)
    return chains.select("merged", _smoothed(F.col("path_bad"), F.col("path_n"), rate).alias("path_rate"), known.alias("known"))


def judged_templates(urls: DataFrame, levels: int) -> DataFrame:
    """One row per host and template: its merged template and verdict."""
    templates = urls.groupBy("host", "template").agg(
        F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("bad")
    )
    templates = staged(templates, "url-templates").withColumn("merged", F.col("template"))
    for level in reversed(range(levels)):
        templates = staged(_merged(templates, level), f"url-merged-{level}")
    own = templates.groupBy("host", "merged").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    rated = salted_left_join(own, path_rates(templates, levels), ["merged"])
    bad = F.col("known") & (_smoothed(F.col("bad"), F.col("n"), F.col("path_rate")) > 0.5)
    verdicts = rated.select("host", "merged", F.when(bad, "block").otherwise("allow").alias("by_template"))
    return templates.select("host", "template", "merged").join(verdicts, ["host", "merged"])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict and template of every row of `pages`."""
    host, path = host_and_path(F.col(url_column))
    urls = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    urls = urls.select("*", rule.alias("rule"), verdict.alias("ruled")).select(
        "*",
        F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int")).alias("label"),
        F.filter(F.split("path", "/"), lambda s: s != "").alias("segments"),
    )
    levels = literal_levels(urls)
    urls = template_tree(urls, levels)
    judged = salted_left_join(urls, judged_templates(urls, levels), ["host", "template"])
    return judged.select(
        F.col("id").alias(id_column),
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "by_template").alias("verdict"),
        F.concat(F.lit("/"), F.concat_ws("/", "merged")).alias("template"),
    )


def oracle(rules: list[tuple[str, str]]) -> str:
    """The same as one DuckDB query over `pages`."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    parts = [(kind, rule, *rule.partition("/")[::2]) for kind, rule in ordered]
    hit = "(host = '{0}' OR suffix(host, '.{0}')) AND starts_with(path, '/{1}')"
    rule = " ".join(f"WHEN {hit.format(h, p)} THEN '{r}'" for _, r, h, p in parts)
    ruled = " ".join(f"WHEN {hit.format(h, p)} THEN '{k}'" for k, _, h, p in parts)
    smoothed = f"({{}} + {SMOOTHING} * {{}}) / ({{}} + {SMOOTHING})"
    own_rate = smoothed.format("h.bad", f"({smoothed.format('p.path_bad', 'r.rate', 'p.path_n')})", "h.n")
    return f"""WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parsed AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
    urls AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parsed),
    ruled AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM urls),
    labelled AS (SELECT *, CASE ruled WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS label,
        list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM ruled),
    depth AS (SELECT coalesce(max(k), 0) AS depth FROM (SELECT k FROM
        (SELECT unnest(range(1, len(segments) + 1)) AS k, unnest(segments) AS value FROM labelled) GROUP BY k, value HAVING count(*) >= {MIN_REPEATS})),
    grown AS (SELECT *, 0 AS level, []::VARCHAR[] AS template FROM labelled
        UNION ALL
        SELECT page_id, host, path, rule, ruled, label, segments, level + 1, list_append(template,
            CASE WHEN (all_n >= {MIN_REPEATS} AND all_n * {MAX_BRANCHES} >= all_total) OR (total >= {MIN_REPEATS} * vals AND n * {MAX_BRANCHES} >= total) THEN value
            WHEN regexp_matches(value, '[0-9]') THEN regexp_replace(value, '[0-9]+', '{{n}}', 'g') ELSE '{{w}}' END)
        FROM (SELECT *, count(*) OVER (PARTITION BY host, parent, value) AS n, count(*) OVER (PARTITION BY host, parent) AS total,
            count(DISTINCT value) OVER (PARTITION BY host, parent) AS vals,
            count(*) OVER (PARTITION BY parent, value) AS all_n, count(*) OVER (PARTITION BY parent) AS all_total
            FROM (SELECT *, segments[level + 1] AS value, array_to_string(template, '/') AS parent FROM grown WHERE level < len(segments)))),
    tree AS (SELECT * FROM grown WHERE level = len(segments)),
    folded AS (SELECT host, template, template AS merged, count(label)::DOUBLE AS n, coalesce(sum(label), 0)::DOUBLE AS bad, (SELECT depth FROM depth) AS level
        FROM tree GROUP BY host, template
        UNION ALL
        SELECT host, template, CASE WHEN general IS NOT NULL AND own_n > 0 AND branches > 1
            AND (own_bad * pool_n - own_n * pool_bad) * (own_bad * pool_n - own_n * pool_bad) <= {CRITICAL} * own_n * pool_bad * (pool_n - pool_bad)
            THEN general ELSE merged END, n, bad, level - 1
        FROM (SELECT *, sum(n) OVER (PARTITION BY host, general) AS pool_n, sum(bad) OVER (PARTITION BY host, general) AS pool_bad,
            count(DISTINCT CASE WHEN own_n > 0 THEN merged END) OVER (PARTITION BY host, general) AS branches
            FROM (SELECT *, sum(n) OVER (PARTITION BY host, merged) AS own_n, sum(bad) OVER (PARTITION BY host, merged) AS own_bad,
                CASE WHEN NOT contains(merged[level], '{{') AND merged[level] <> '*' THEN
                    list_transform(merged, lambda x, i: CASE WHEN i = level THEN '*' ELSE x END) END AS general FROM folded WHERE level > 0))),
    merged AS (SELECT * FROM folded WHERE level = 0),
    paths AS (SELECT merged, least(len(merged), (SELECT depth FROM depth)) AS deepest, sum(n) AS path_n, sum(bad) AS path_bad FROM merged GROUP BY ALL),
    prefixes AS (SELECT *, unnest(range(0, deepest + 1)) AS k FROM paths),
    nodes AS (SELECT k, merged[1:k] AS prefix, sum(path_n) AS n, sum(path_bad) AS bad FROM prefixes GROUP BY ALL),
    rates AS (SELECT k, prefix, CASE WHEN n > 0 THEN bad / n ELSE 0.0::DOUBLE END AS rate, FALSE AS known FROM nodes WHERE k = 0
        UNION ALL
        SELECT c.k, c.prefix, {smoothed.format("c.bad", "r.rate", "c.n")}, r.known OR c.n > 0 FROM rates r JOIN nodes c ON c.k = r.k + 1 AND c.prefix[1:c.k - 1] = r.prefix),
    hosts AS (SELECT host, merged, sum(n) AS n, sum(bad) AS bad FROM merged GROUP BY ALL),
    verdicts AS (SELECT h.host, h.merged, CASE WHEN (p.path_n > 0 OR r.known) AND {own_rate} > 0.5 THEN 'block' ELSE 'allow' END AS by_template
        FROM hosts h JOIN paths p ON h.merged = p.merged JOIN rates r ON r.k = p.deepest AND r.prefix = p.merged[1:p.deepest])
    SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.ruled, v.by_template) AS verdict, '/' || array_to_string(m.merged, '/') AS template
    FROM tree t JOIN merged m ON t.host = m.host AND t.template = m.template JOIN verdicts v ON m.host = v.host AND m.merged = v.merged"""
