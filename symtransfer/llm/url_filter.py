"""Captures against dated list entries: validity intervals and an as-of join.

An entry adds a host to a list, or removes it, from a date on. Per list and host the latest entry
holds until the next one, so entries become validity intervals. A capture's host and each parent
domain look up their intervals, packed per host (a list's history, whose size doesn't depend on
the captures); the last interval that began by the fetch time decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read

# The query's dated entries (list, host, action, day).
ENTRIES = [
    ("spam", "spam-farm.example.org", "add", "2024-01-01"),
    ("spam", "spam-farm.example.org", "remove", "2024-04-01"),
    ("spam", "spam-farm.example.org", "add", "2024-07-01"),
    ("spam", "cheap-pills.example.com", "add", "2024-03-01"),
    ("drugs", "cheap-pills.example.com", "add", "2024-02-15"),
    ("drugs", "cheap-pills.example.com", "remove", "2024-11-01"),
    ("mobile", "m.therou.example.com", "add", "2024-05-01"),
    ("registry", "example.net", "add", "2024-06-01"),
    ("registry", "example.net", "remove", "2024-06-15"),
    ("registry", "example.net", "add", "2024-10-01"),
    ("adult", "casino.example.net", "add", "2024-01-01"),
]
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


#: Bytes of listed hosts and their intervals that go to all executors at once; beyond them, hosts with more captures than HOT are dealt into SALTS parts.
BROADCAST = 16_000_000
HOT = 1_000_000
SALTS = 64


def host_of(url):
    """In lower case, without a trailing dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def domains_of(host):
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """list, host, valid_from, valid_to (null: still) of dated entries list, host, action, day.

    Of one list's entries for a host on one day, a removal wins. Rows with a null in any of these columns are no entries.
    """
    entries = entries.select("list", F.lower("host").alias("host"), "action", F.col("day").cast("date").alias("day")).dropna()
    daily = entries.groupBy("list", "host", "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    order = Window.partitionBy("list", "host").orderBy("day")
    return daily.withColumn("valid_to", F.lead("day").over(order)).where(~F.col("removed")).select("list", "host", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """For every capture: its columns id_col, url_col, time_col, host, lists (those active at its time, sorted) and kept (none is).

    A null url or time, or a url without a host, is on no list. Repeated rows are captures of their own; empty tables give
    no rows, or no lists. Other columns are ignored.
    """
    packed = validity(entries).groupBy("host").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("intervals"))
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).cast("date").alias("at"))
    rows = rows.withColumn("host", host_of("url"))
    return _joined(rows, packed).select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("at").alias(time_col), "host", "lists", (F.size("lists") == 0).alias("kept"))


def _joined(rows: DataFrame, packed: DataFrame) -> DataFrame:
    # hosts and their domains are few against captures: each distinct host meets the lists once
    hosts = rows.select("host").dropna().distinct().withColumn("domain", F.explode(domains_of(F.col("host"))))
    listed = hosts.join(packed.withColumnRenamed("host", "domain"), "domain").groupBy("host").agg(F.flatten(F.collect_list("intervals")).alias("intervals"))
    # only hosts that are on a list; where they are few, a host with a third of all captures needn't meet its row in one task
    listed = cut_lineage(listed)
    size = listed.agg(F.sum(F.octet_length("host") + 40 * F.size("intervals"))).first()[0] or 0
    if size <= BROADCAST:
        listed = F.broadcast(listed)
    else:
        salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
        hot = rows.groupBy("host").count().where(F.col("count") > HOT).select("host")
        listed = listed.join(hot.withColumn("hot", F.lit(True)), "host", "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
        rows = rows.join(hot.withColumn("hot", F.lit(True)), "host", "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")
    active = F.filter("intervals", lambda x: (x["valid_from"] <= F.col("at")) & (x["valid_to"].isNull() | (F.col("at") < x["valid_to"])))
    lists = F.coalesce(F.array_sort(F.array_distinct(F.transform(active, lambda x: x["list"]))), F.array().cast("array<string>"))
    return rows.join(listed, [c for c in ("host", "salt") if c in listed.columns], "left").withColumn("lists", lists)


def sample_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "list string, host string, action string, day string")


def op5_temporal_url_lists(spark, sf_dir):
    """pages have no fetch time; the query takes day page_id modulo 366 of 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(pmod(page_id, 366) as int))").alias("fetched"))
    out = evaluate(pages, sample_entries(spark))
    return out.select("page_id", "host", F.array_join("lists", ",").alias("lists"), "kept")


SQL = f"""
WITH entries(list, host, action, day) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)}),
daily AS (SELECT list, host, day, max(action = 'remove') AS removed FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, host ORDER BY day) AS upto FROM daily),
p AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS day,
  nullif(regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.+$', ''), '') AS host, row_number() OVER () AS r FROM pages),
hits AS (SELECT p.r, s.list FROM p JOIN spans s ON (p.host = s.host OR ends_with(p.host, '.' || s.host)) AND NOT s.removed AND s.day <= p.day AND (s.upto IS NULL OR p.day < s.upto)),
l AS (SELECT r, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM hits GROUP BY r)
SELECT page_id, host, coalesce(lists, '') AS lists, lists IS NULL AS kept FROM p LEFT JOIN l USING (r)
"""
