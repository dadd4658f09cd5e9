"""Secret scans with multipart credential linking.

Base secrets are found by three patterns and stand on their own. Weak candidates (a bare 40-character key, an endpoint, a
user name) mean little alone; each is reported only if a complementary part lies within ``scope`` characters in the same
document. That is an interval join of the parts with the scopes around them, done as two sweeps: parts are sorted by start within
their document, and a running maximum from the start and a running minimum from the end carry the nearest complement before and after. So a document with many parts makes no pairs,
and takes time in proportion to their number, but for sorting.

Everything is DataFrame code. A text is split at a pattern's matches, and the running lengths of the pieces
and matches give the positions, in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_width, stored

#: Kind: (pattern, shortest match, group whose length counts). For runs of one class a count of at least n finds the same
#: maximal runs as ``+`` with a filter on length; for assign it would not, as a match that fails still uses up its text.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]{12,}", 16, 0),
    "hex": (r"[0-9a-f]{32,}", 32, 0),
}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 40, 0),
    "endpoint": (r"""https?://[^\x00-\x20"'<>]+""", 12, 0),
    "user": (r"""(?i:\b(?:user(?:name)?|login|client_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 4, 1),
}
#: The kinds that make each weak kind worth reporting.
COMPLEMENTS = {"key": ("access",), "endpoint": ("assign", "access"), "user": ("assign", "hex")}
ORDER = {k: i for i, k in enumerate([*BASE, *WEAK])}


def _found(text: Column, kind: str, where: Column | None = None) -> Column:
    """An array of (kind, i, gap, size, counts): the characters before each match since the last, and its own."""
    pattern, _, group = {**BASE, **WEAK}[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(part, F.length).alias("counts")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["size"].alias("size"), x["counts"].alias("counts")),
    )
    rows = F.filter(rows, lambda x: x["size"].isNotNull())
    has = text.rlike(pattern) if where is None else where & text.rlike(pattern)
    return F.when(has, rows).otherwise(F.filter(F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(0).alias("counts"))), lambda x: F.lit(False)))


def find_secrets(docs: DataFrame, scope: int = 300) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and secrets, an array of (start, rank, kind, stop, linked) in order.

    start and stop count code points, stop is exclusive, rank orders kinds that start together. linked tells the weak kinds, which
    are there only because a complement lies within scope. Null and empty texts give an empty array. Each row is scanned on its own, whatever its
    doc_id, so null and repeated ids give one result per row; other columns are not read. An empty table gives no rows.
    """
    text = F.col("text")
    base_hit = reduce(lambda a, b: a | b, [text.rlike(p) for p, _, _ in BASE.values()])
    parts = F.concat(*[_found(text, k) for k in BASE], *[_found(text, k, base_hit) for k in WEAK])
    rows = (
        docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
        .select("doc_id", "row", F.explode_outer(parts).alias("p"))
        .select("doc_id", "row", "p.*")
        .repartition(shuffle_width(docs.sparkSession), "row")
    )
    run = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = reduce(lambda c, k: c.when(F.col("kind") == k, {**BASE, **WEAK}[k][1]), {**BASE, **WEAK}, F.when(F.lit(False), 0))
    placed = (
        rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(run))
        .withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("ok", F.coalesce(F.col("counts") >= least, F.lit(False)))
    )
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, ORDER[k]), ORDER, F.when(F.lit(False), 0))
    placed = placed.withColumn("rank", rank)
    past = (Window.unboundedPreceding, -1)  # grows by a row at a time; what follows is the past of the sweep from the end
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(*past)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(*past)
    near = F.lit(False)
    for kind, others in COMPLEMENTS.items():
        is_other = F.col("ok") & F.col("kind").isin(*others)
        last, following = F.max(F.when(is_other, F.col("stop"))).over(before), F.min(F.when(is_other, F.col("start"))).over(after)
        close = (F.col("start") - last <= scope) | (following - F.col("stop") <= scope)
        near = near | ((F.col("kind") == kind) & F.coalesce(close, F.lit(False)))
    weak = F.col("kind").isin(*WEAK)
    judged = placed.withColumn("near", near).withColumn("kept", F.col("ok") & (~weak | F.col("near")))
    span = F.struct("start", "rank", "kind", "stop", weak.alias("linked"))
    return judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("secrets")
    ).drop("row")


def without_secrets(docs: DataFrame) -> DataFrame:
    """The rows of docs (text) in whose own text ``find_secrets`` finds no span, with all their columns; null and empty texts stay.

    What the scan finds depends on the text alone, so it goes by a 128-bit digest of the text and not by ids: null and repeated ids are judged row by row. Equal texts go or stay together. Other columns are
    not read.
    """
    digest = F.md5("text")
    found = find_secrets(docs.select(digest.alias("doc_id"), "text")).where(F.size("secrets") > 0)
    found = stored(found.select(F.col("doc_id").alias("__text")).distinct(), "secrets")
    return docs.select(digest.alias("__text"), F.struct("*").alias("__row")).join(found, "__text", "left_anti").select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
