"""URL filter by a path-template tree, in DataFrame operations only.

Every url has a host and path segments. Segments that look variable (numbers, dates, hexadecimal ids, long
slugs) become wildcards that keep the extension; equal rest paths are counted together before anything is
shuffled again. Level by level, to the deepest path of the data, the tree of each host is then merged: a branch stays on its own only if its
labelled share of bad pages differs from that of its siblings by a two-proportion z-test, and all others fall
together in a wildcard. A template is rejected if its labelled purity, smoothed towards the share of good pages
of all labelled urls, is under ``PURITY``. Rules given by the caller come first; of several that fit a url the
longest wins.

The tree is written to the shared folder after each level. The counts are combined before each shuffle, so a host with a third of all rows is a few rows there; joins
with the rows of ``pages`` are plain equi-joins that Spark may split where they are skewed.

Defined results: a null url, or one without "://", has an empty host and path and is judged like others of
that kind; urls without labels are allowed; repeated rows give repeated rows; an id labelled several times is
bad if one label says so; no labels at all: everything is allowed; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels that the tree has at least, and those of the SQL, which joins what lies below into one segment.
DEPTH = 3
#: Labelled urls that a branch needs to stay on its own, and the z value by which it differs.
LEAST_LABELS, Z = 20, 1.96
#: Purity under which a template is rejected, and the number of prior observations it is smoothed with.
PURITY, PRIOR = 0.5, 10.0
#: Levels below DEPTH that a path does not have, at a prefix's end.
TAIL = "^((?:/[^/]*){%d}.*?)/+$" % DEPTH
VARIABLE = r"^(?:[0-9][0-9._-]*|[0-9a-fA-F-]{8,}|.{40,})(\.[A-Za-z]{1,5})?$"
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def number_of(path: Column) -> Column:
    """The first path segment that is a number, an extension aside; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[A-Za-z]+)?(?:/|$)", 1), F.lit("")), F.lit("9" * 18)).cast("long")


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def generalised(path: Column) -> Column:
    """The segments of ``path``, variable ones as wildcards."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), lambda x: F.regexp_replace(x, VARIABLE, "*$1"))


def fit(urls: DataFrame, least: int = LEAST_LABELS, z: float = Z, least_purity: float = PURITY, weight: float = PRIOR) -> DataFrame:
    """The rejected rest paths: (host, parts, template), from ``urls`` (host, path, bad); bad is null without a label.

    A branch with ``least`` labels that differs from its siblings by ``z`` stays on its own; a template is rejected
    under ``least_purity``, smoothed with ``weight`` observations of the purity of all.
    """
    keys = urls.groupBy("host", generalised(F.col("path")).alias("parts")).agg(F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    keys = save(keys.withColumn("prefix", F.lit("")), "templates")
    deepest = keys.agg(F.max(F.size("parts"))).first()[0] or 0
    for d in range(max(DEPTH, deepest)):
        at = ["host", "prefix"]
        if d >= DEPTH and keys.groupBy(*at).agg(F.sum("labelled").alias("l"), F.max(F.size("parts")).alias("n")).where((F.col("l") > least) & (F.col("n") > d)).isEmpty():
            break  # no template with segments left has the labels to part
        keys = keys.withColumn("part", F.coalesce(F.get("parts", F.lit(d)), F.lit("")))
        child = keys.groupBy(*at, "part").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        parent = child.groupBy(*at).agg(F.count("*").alias("fan"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        rest, pooled = F.col("pl") - F.col("l"), F.col("pb") / F.col("pl")
        gap = F.abs(F.col("b") / F.col("l") - (F.col("pb") - F.col("b")) / rest)
        apart = (F.col("l") >= least) & (rest > 0) & (gap >= z * F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.when(rest > 0, rest))))
        own = ~F.startswith("part", F.lit("*")) & ((F.col("fan") == 1) | F.coalesce(F.when((F.col("l") > 0) & (rest > 0), apart), F.lit(False)))
        named = child.join(parent, at).select(*at, "part", F.concat("prefix", F.lit("/"), F.when(own, F.col("part")).otherwise(F.lit("*"))).alias("next"))
        keys = save(keys.join(named, [*at, "part"]).select("host", "parts", "labelled", "bad", F.col("next").alias("prefix")), "templates")
    templates = keys.groupBy("host", "prefix").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    prior = templates.agg(F.coalesce(1 - F.sum("b") / F.nullif(F.sum("l"), F.lit(0)), F.lit(1.0)).alias("prior"))
    purity = (F.col("l") - F.col("b") + weight * F.col("prior")) / (F.col("l") + weight)
    rejected = templates.join(F.broadcast(prior)).where((F.col("l") > 0) & (purity < least_purity)).select("host", "prefix")
    return keys.join(rejected, ["host", "prefix"]).select("host", "parts", F.concat("host", F.regexp_replace("prefix", TAIL, "$1")).alias("template"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, **settings) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, bad 0/1) names bad pages by the number in their path. template is the rejected one.
    ``settings`` are those of :func:`fit`.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    numbered = rows.select("host", "path", number_of(F.col("path")).alias("doc_id"))
    rejected = fit(numbered.join(known, "doc_id", "left"), **settings)
    rule, kind = matching_rule(F.col("host"), F.col("path"), rules)
    out = rows.withColumn("parts", generalised(F.col("path"))).join(rejected, ["host", "parts"], "left")
    verdict = F.coalesce(kind, F.when(F.col("template").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template")


def op2_url_filter(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels)


def _oracle() -> str:
    """SQL for the query: rules as cases, and one block of the tree for each level."""
    fits = lambda text: "(host = '{0}' OR host LIKE '%.{0}') AND starts_with(path, '{1}')".format(*(lambda d, s, p: (d, s + p))(*text.partition("/")))
    ordered = sorted(RULES, key=lambda x: (len(x[1]), x[1]), reverse=True)
    rule = "CASE " + " ".join(f"WHEN {fits(text)} THEN '{text}'" for _, text in ordered) + " END"
    kind = "CASE " + " ".join(f"WHEN {fits(text)} THEN '{verdict}'" for verdict, text in ordered) + " END"
    levels = ""
    for d in range(DEPTH):
        levels += f"""
, c{d} AS (SELECT host, prefix, coalesce(parts[{d + 1}], '') AS part, sum(labelled) AS l, sum(bad) AS b FROM k{d} GROUP BY ALL)
, p{d} AS (SELECT host, prefix, count(*) AS fan, sum(l) AS pl, sum(b) AS pb FROM c{d} GROUP BY ALL)
, n{d} AS (SELECT c.host, c.prefix, c.part, c.prefix || '/' || CASE WHEN NOT starts_with(part, '*') AND (fan = 1 OR
    CASE WHEN l > 0 AND pl - l > 0 THEN l >= {LEAST_LABELS} AND abs(b / l - (pb - b) / (pl - l)) >= {Z} * sqrt(pb / pl * (1 - pb / pl) * (1 / l + 1 / (pl - l))) ELSE false END)
    THEN part ELSE '*' END AS next FROM c{d} c JOIN p{d} p USING (host, prefix))
, k{d + 1} AS (SELECT k.host, parts, labelled, bad, next AS prefix FROM k{d} k JOIN n{d} n ON k.host = n.host AND k.prefix = n.prefix AND coalesce(k.parts[{d + 1}], '') = n.part)"""
    variable = VARIABLE.replace("'", "''")
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
g AS (SELECT *, regexp_replace(path, '^/', '') AS rest, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[A-Za-z]+)?(?:/|$)', 1), '') AS BIGINT) AS doc_id FROM u),
h AS (SELECT *, string_split(rest, '/') AS a FROM g),
i AS (SELECT page_id, host, path, doc_id, list_transform(CASE WHEN len(a) <= {DEPTH} THEN a ELSE list_append(a[1:{DEPTH - 1}], array_to_string(a[{DEPTH}:], '/')) END, lambda x: regexp_replace(x, '{variable}', '*\\1')) AS parts FROM h),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
k0 AS (SELECT host, parts, CAST(count(bad) AS DOUBLE) AS labelled, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad, '' AS prefix FROM i LEFT JOIN b USING (doc_id) GROUP BY host, parts){levels}
, t AS (SELECT host, prefix, sum(labelled) AS l, sum(bad) AS b FROM k{DEPTH} GROUP BY ALL)
, q AS (SELECT host, prefix FROM t WHERE l > 0 AND (l - b + {PRIOR} * (SELECT coalesce(1 - sum(b) / nullif(sum(l), 0), 1.0) FROM t)) / (l + {PRIOR}) < {PURITY})
, x AS (SELECT k.host, parts, k.host || k.prefix AS template FROM k{DEPTH} k JOIN q USING (host, prefix))
SELECT page_id, i.host, path, {rule.replace("host", "i.host")} AS rule, coalesce({kind.replace("host", "i.host")}, CASE WHEN template IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, template
FROM i LEFT JOIN x ON x.host = i.host AND x.parts = i.parts
"""


ORACLE = _oracle()
