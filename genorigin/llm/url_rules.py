"""URL filters by a sort-merge range join.

A host is keyed by its labels from last to first, each in hex and closed by ``.``: ``a.example.net`` becomes
``hex(net).hex(example).hex(a).``. A rule for ``example.net`` then covers exactly the keys in the interval
``[hex(net).hex(example)., hex(net).hex(example)/)``, as ``/`` follows ``.``. Intervals of hosts nest or are
disjoint, so a sweep over the sorted keys can keep the stack of rules that are open. The stack at each opening and
closing is worked out on the rules alone, by joining each rule's host to the hosts above it; the sweep then
carries the last stack seen to every host that follows.

Only distinct hosts are swept, with the stacks, in ranges of their keys; what is open at the end of a range is carried into the next ones by a table of one row for each range. Urls get
their host's stack by a join, which splits a host that holds a third of them, and take the longest rule whose path fits. A row holds the rules of one host and those above it, however many there
are in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; empty for null or no ``://``."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    return F.coalesce(F.when(at > 0, F.translate(host, UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def _labels(host: Column) -> Column:
    return F.transform(F.reverse(F.split(host, r"\.")), lambda x: F.hex(F.encode(x, "UTF-8")))


def _key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """From rules (host, path, verdict), the stack of open rules from each key on: (key, stack)."""
    rules = rules.where("host is not null and host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"),
        F.concat("host", "path").alias("rule"), "path", "verdict",
    )
    own = (
        rules.select(_labels(F.col("host")).alias("labels"), rule.alias("rule"))
        .groupBy("labels")
        .agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    )
    above = own.select(
        "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n")
    ).select("labels", F.expr("slice(labels, 1, n)").alias("upper"))
    upper = own.select(F.col("labels").alias("upper"), F.col("rules").alias("upper_rules"))
    stacks = above.join(upper, "upper").groupBy("labels").agg(
        F.flatten(F.collect_list("upper_rules")).alias("open"),
        F.flatten(F.collect_list(F.when(F.size("upper") < F.size("labels"), F.col("upper_rules")))).alias("shut"),
    )
    return stacks.select(
        F.explode(
            F.array(
                F.struct(_key(F.col("labels")).alias("key"), F.col("open").alias("stack")),
                F.struct(F.concat(F.array_join("labels", "."), F.lit("/")).alias("key"), F.col("shut").alias("stack")),
            )
        ).alias("x")
    ).select("x.*")


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack) of the distinct hosts that any rule covers, by a sweep over hosts and the rules' stacks in order of key."""
    points = hosts.select(_key(_labels(F.col("host"))).alias("key"), F.lit(1).alias("kind"), "host")
    events = rule_stacks(rules).select("key", F.lit(0).alias("kind"), "stack")
    order = ["key", "kind"]
    dealt = points.unionByName(events, allowMissingColumns=True).repartitionByRange(shuffle_width(hosts.sparkSession), *order)
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()), "keys")
    seen = F.last("stack", ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = dealt.groupBy("range").agg(F.max_by(F.when(F.col("kind") == 0, F.col("stack")), F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    carried = F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    swept = dealt.withColumn("seen", seen).join(F.broadcast(ends.select("range", carried.alias("carried"))), "range")
    open_ = swept.where("kind = 1").select("host", F.coalesce("seen", "carried").alias("stack"))
    return stored(open_.where("size(stack) > 0"), "stacks")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to pages; columns of these names are replaced.

    rules: (host, path, verdict). A rule fits its host and all subdomains if the url's path starts with the rule's
    path; the longest rule (host and path together, then host) wins, and of equal rules the first verdict in order.
    A url that no rule fits gets rule null and the default verdict. A null url, or one without ``://``, has an empty
    host and path, which no rule fits. Rules with a null or empty host are ignored; repeated rows stay repeated;
    empty tables give empty results or the default everywhere.
    """
    new = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in new]
    parts = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path")
    )
    judged = parts.join(host_stacks(parts.select("host").distinct(), rules), "host", "left")
    fits = F.filter(F.col("stack"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["host_size"], r["rule"], r["verdict"])))
    return judged.withColumn("best", best).select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
