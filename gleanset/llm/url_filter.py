"""URL filters by a sort-merge range join of reversed-host keys, in DataFrame functions only.

A host's canonical key is its labels in reverse, each followed by a dot (``blog.example.org`` is ``org.example.blog.``), so a
rule for a host and its subdomains is the interval of keys that start with the rule's. A path rule is an interval in the same
way, under its host. Such intervals nest or are disjoint.

``sweep`` joins keys with intervals. Both are dealt into ranges of keys and sorted there. Wherever a rule opens, the stack of
rules that are open from there on is known: the rule and those around it. So in key order the last stack seen, without
the rules whose interval has ended, holds all rules of a key; a range starts with the last stack of the ranges before it.

Two sweeps give the result: distinct hosts against the rules' hosts, then, of the urls under some such host only, distinct (rule
host, path) keys against path rules. Both work on distinct keys, so that neither a host with a third of all pages nor
a path that all hosts have makes a range large; the rows get their rule back by joins, whose hot keys
adaptive execution splits. Rules are never broadcast by hand and may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, load

# The letters that are lower-cased.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the query (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: What urls without any rule get, if they have a host.
OTHERWISE = "allow"


def cut(text: Column, *marks: str) -> Column:
    """Text up to the first of the marks."""
    for m in marks:
        text = F.call_function("substring_index", text, F.lit(m), F.lit(1))
    return text


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.translate(cut(F.substring(url, at + 3, F.length(url)), "/", "?", "#"), UPPER, LOWER)).otherwise("")


def path_of(url: Column, host: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, cut(F.substring(url, at + 3 + F.length(host), F.length(url)), "?", "#")).otherwise("")


def labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def joined(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def host_key(host: Column) -> Column:
    return joined(labels(host))


def path_key(host_key: Column, path: Column) -> Column:
    """No host has a slash, so only rules of the same host can be prefixes of each other."""
    return F.concat(host_key, F.lit("/"), path)


def nested(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule with the rules around it, the outermost first. ``above`` has all keys that may be of rules around it."""
    entry = F.struct("key", "note").alias("entry")
    around = rules.select(F.col("key").alias("inner"), F.explode("above").alias("key")).join(rules.select("key", "note"), "key").select(F.col("inner").alias("key"), entry)
    return rules.select("key", entry).unionByName(around).groupBy("key").agg(F.array_sort(F.collect_list("entry")).alias("stack"))


def sweep(keys: DataFrame, rules: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(key, open): of the distinct ``keys`` that start with some rule's key, those rules as (key, note), the longest last."""
    none = rules.select(F.array(F.struct("key", "note")).alias("stack")).schema["stack"].dataType
    events = nested(rules).withColumn("asks", F.lit(False)).unionByName(keys.select("key", F.lit(None).cast(none).alias("stack"), F.lit(True).alias("asks")))
    ranges = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = work.keep(events.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), name)
    # A row for each range; they are as many as there are shuffle partitions.
    last = dealt.groupBy("range").agg(F.expr("max_by(stack, key) FILTER (WHERE NOT asks)").alias("stack"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("range", F.last("stack", ignorenulls=True).over(earlier).alias("stack"), F.lit("").alias("key"), F.lit(False).alias("asks")).where("stack IS NOT NULL")
    in_order = Window.partitionBy("range").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.unionByName(carried).select("key", "asks", F.last("stack", ignorenulls=True).over(in_order).alias("stack"))
    still = F.filter("stack", lambda e: F.startswith(F.col("key"), e["key"]))
    return seen.where("asks AND stack IS NOT NULL").select("key", still.alias("open")).where(F.size("open") > 0)


def known(rules: DataFrame) -> DataFrame:
    """(host, path, verdict): one row per host and path; block wins over allow."""
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce("path", F.lit(""))
    return rules.where("host <> '' AND verdict IN ('allow', 'block')").groupBy(host.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))


def host_rules(rules: DataFrame) -> DataFrame:
    """The rules' hosts as intervals; every leading run of labels may be a host around."""
    parts = labels(F.col("host"))
    above = F.transform(F.slice(F.sequence(F.lit(0), F.size(parts) - 1), 2, F.size(parts)), lambda k: joined(F.slice(parts, 1, k)))
    return rules.select("host").distinct().select(host_key(F.col("host")).alias("key"), above.alias("above"), F.lit("").alias("note"))


def path_rules(rules: DataFrame) -> DataFrame:
    """The rules as intervals under their host. Rules around one are of the same host and of a smaller length that occurs there."""
    rules = rules.withColumn("key", path_key(host_key(F.col("host")), F.col("path")))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("key")).alias("lengths"))
    shorter = F.transform(F.filter("lengths", lambda n: n < F.length("key")), lambda n: F.left(F.col("key"), n))
    text = F.concat("host", "path")
    note = F.struct(F.length(text).alias("length"), F.length("host").alias("host_length"), "verdict", text.alias("rule"))
    return rules.join(lengths, "host").select("key", F.array_distinct(shorter).alias("above"), note.alias("note"))


def url_filter(pages: DataFrame, rules: DataFrame, otherwise: str = OTHERWISE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null without any), verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains of it, if the url's path starts with
    the rule's. The longest (host and path together) wins, of equally long ones that of the longer host. A url without a rule
    gets ``otherwise``; without a host it is no page's url and is blocked.

    Defined cases: null urls and those without ``://`` have an empty host and path; very long urls are compared whole; user
    names, ports and final dots are part of the host; rules with an empty or null host or another verdict are left out, a null
    path is the empty one, and a rule that is given twice blocks if one of them does; repeated rows and ids are judged row by
    row; other columns aren't looked at; an empty table gives no rows, and without rules every url gets what it gets without one.
    """
    url = F.col(url_col).cast("string")
    host = host_of(url)
    parsed = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path_of(url, host), F.lit("")).alias("path"))
    work = Scratch(pages.sparkSession, "urls")
    rules = work.keep(known(rules), "rules")
    hosts = sweep(parsed.where("host <> ''").select("host").distinct().select(host_key(F.col("host")).alias("key")), host_rules(rules), work, "hosts")
    under = parsed.where("host <> ''").select("host", "path").distinct().withColumn("key", host_key(F.col("host"))).join(hosts, "key")
    asked = under.select("host", "path", F.explode("open.key").alias("under")).select("host", "path", path_key(F.col("under"), F.col("path")).alias("key"))
    asked = work.keep(asked, "asked")
    found = sweep(asked.select("key").distinct(), path_rules(rules), work, "paths").select("key", F.element_at("open", -1)["note"].alias("note"))
    best = work.keep(asked.join(found, "key").groupBy("host", "path").agg(F.max("note").alias("note")), "best")
    work.drop("rules", "hosts", "asked", "paths")
    verdict = F.coalesce("note.verdict", F.when(F.col("host") == "", "block").otherwise(otherwise))
    return parsed.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("note.rule").alias("rule"), verdict.alias("verdict"))


def contract_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(load(spark, sf_dir, "pages"), contract_rules(spark))


SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(map(str, RULES))}),
r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host FROM r),
u AS (SELECT page_id, host, regexp_extract(substring(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
best AS (
  SELECT k.host, k.path, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule, arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM u) AS k JOIN rules ON (k.host = rules.host OR ends_with(k.host, '.' || rules.host)) AND starts_with(k.path, rules.path)
  GROUP BY k.host, k.path)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, CASE WHEN u.host = '' THEN 'block' ELSE '{OTHERWISE}' END) AS verdict
FROM u LEFT JOIN best ON u.host = best.host AND u.path = best.path
"""
