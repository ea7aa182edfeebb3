"""Tables as collections of entities and members, so every operator runs on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Side:
    """entity: entity_id, ord, flags, refs, n_methods, n_fields, and more; member: entity_id, kind, ord, name, desc, access, fine, coarse, init_tag.

    counts, bands: key counts of the members and MinHash bands, where they are prepared; otherwise each plan computes its own.
    """

    entity: DataFrame
    member: DataFrame
    counts: DataFrame | None = None
    bands: DataFrame | None = None

    def only(self, ids: DataFrame) -> Side:
        return Side(self.entity.join(ids, "entity_id", "left_semi"), self.member.join(ids, "entity_id", "left_semi"))

    def without(self, ids: DataFrame) -> Side:
        return Side(self.entity.join(ids, "entity_id", "left_anti"), self.member.join(ids, "entity_id", "left_anti"))

    def where(self, condition) -> Side:
        return Side(self.entity.where(condition), self.member.where(condition))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def member_sizes(member: DataFrame) -> DataFrame:
    return member.groupBy("entity_id").agg(F.count_if(F.col("kind") == "m").alias("n_methods"), F.count_if(F.col("kind") == "f").alias("n_fields"))


def with_sizes(entity: DataFrame, member: DataFrame) -> DataFrame:
    return entity.join(member_sizes(member), "entity_id", "left").fillna(0, ["n_methods", "n_fields"])


def line_class_counts(line):
    """Upper, lower, digit, space and other characters, as one text."""
    kinds = [F.length(F.regexp_replace(line, f"[^{c}]", "")) for c in ("A-Z", "a-z", "0-9", " ")]
    other = F.length(line) - kinds[0] - kinds[1] - kinds[2] - kinds[3]
    return F.concat_ws(",", *[k.cast("string") for k in [*kinds, other]])


def md5_31(text):
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(2147483648))


def document_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("entity_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "name"))
    rows = rows.where(F.trim("name") != "")
    return rows.select(
        "entity_id", F.lit("m").alias("kind"), "ord", "name", F.size(F.split(F.trim("name"), " +")).cast("string").alias("desc"), F.lit(1).alias("access"),
        md5_31(F.col("name")).alias("fine"), line_class_counts(F.col("name")).alias("coarse"), F.lit(0).alias("init_tag"),
    )


def document_fields(docs: DataFrame) -> DataFrame:
    """Distinct tokens with a digit, at their first place."""
    rows = docs.select(F.col("doc_id").alias("entity_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "[ \n]+")).alias("ord", "name")).where(F.col("name").rlike("[0-9]"))
    rows = rows.groupBy("entity_id", "name").agg(F.min("ord").alias("ord"))
    bits = [(c, b) for c, b in (("[A-Z]", 1), ("[a-z]", 2), ("[0-9]", 4), ("[^A-Za-z0-9]", 8))]
    access = sum((F.when(F.col("name").rlike(c), b).otherwise(0) for c, b in bits[1:]), F.when(F.col("name").rlike(bits[0][0]), 1).otherwise(0))
    return rows.select(
        "entity_id", F.lit("f").alias("kind"), "ord", "name", F.length("name").cast("string").alias("desc"), access.alias("access"),
        F.lit(0).cast("long").alias("fine"), F.lit("").alias("coarse"), F.lit(0).alias("init_tag"),
    )


def documents(spark: SparkSession, sf_dir: str) -> Side:
    docs = table(spark, sf_dir, "documents")
    member = document_lines(docs).unionByName(document_fields(docs))
    text = F.coalesce("text", F.lit(""))
    flags = sum(
        (F.when(c, b).otherwise(0) for c, b in ((text.contains("@"), 2), (text.contains("http"), 4), (text.contains("\n"), 8), (F.col("n_chars") > 1000, 16))),
        F.when(text.rlike("[0-9]"), 1).otherwise(0),
    )
    refs = F.array(F.concat(F.lit("S:"), "lang"), F.concat(F.lit("I:"), "source"))
    entity = docs.select(F.col("doc_id").alias("entity_id"), F.col("doc_id").alias("ord"), flags.alias("flags"), refs.alias("refs"), "lang", "source")
    return Side(with_sizes(entity, member), member)


def document_words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", distinct: bool = True) -> DataFrame:
    """entity_id, element: words of each text, each once unless `distinct` is off (a minimum over them doesn't mind, and needs no shuffle of words)."""
    rows = table(spark, sf_dir, name).select(F.col(key).alias("entity_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "[ \n]+")).alias("element"))
    rows = rows.where("element != ''")
    return rows.distinct() if distinct else rows


def customers(spark: SparkSession, sf_dir: str) -> Side:
    orders = table(spark, sf_dir, "orders")
    base = orders.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), "o_orderpriority", "o_orderstatus")
    methods = base.select("entity_id", F.lit("m").alias("kind"), "ord", "name", F.col("o_orderpriority").alias("desc"), F.lit(1).alias("access"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("fine"), F.col("o_orderstatus").alias("coarse"), F.lit(0).alias("init_tag"))
    fields = base.select("entity_id", F.lit("f").alias("kind"), "ord", "name", F.col("o_orderstatus").alias("desc"), (F.col("ord") % 3 + 1).cast("int").alias("access"), F.lit("").alias("fine"), F.lit("").alias("coarse"), (F.col("ord") % 2).cast("int").alias("init_tag"))
    member = methods.unionByName(fields)
    customer = table(spark, sf_dir, "customer")
    flags = F.when(F.col("c_mktsegment") < "B", 1).when(F.col("c_mktsegment") < "G", 3).when(F.col("c_mktsegment") < "I", 4).otherwise(12)
    entity = customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("ord"), flags.alias("flags"), F.array(F.concat(F.lit("S:"), F.col("c_nationkey").cast("string"))).alias("refs"), F.col("c_nationkey").alias("nation"))
    return Side(with_sizes(entity, member), member)


DOCUMENTS_SQL = """
raw AS (SELECT doc_id AS entity_id, coalesce(text, '') AS text, n_chars, lang, source FROM documents),
lines AS (SELECT entity_id, i AS ord, name, CAST(len(string_split_regex(trim(name), ' +')) AS VARCHAR) AS descr,
  CAST(('0x' || substr(md5(name), 1, 8))::BIGINT % 2147483648 AS VARCHAR) AS fine,
  length(regexp_replace(name, '[^A-Z]', '', 'g')) AS c1, length(regexp_replace(name, '[^a-z]', '', 'g')) AS c2,
  length(regexp_replace(name, '[^0-9]', '', 'g')) AS c3, length(regexp_replace(name, '[^ ]', '', 'g')) AS c4, length(name) AS c0
  FROM (SELECT entity_id, unnest(p) AS name, unnest(range(len(p))) AS i FROM (SELECT entity_id, string_split(text, chr(10)) AS p FROM raw)) WHERE trim(name) <> ''),
fields AS (SELECT entity_id, name, min(i) AS ord, CAST(length(name) AS VARCHAR) AS descr,
  CASE WHEN regexp_matches(name, '[A-Z]') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(name, '[a-z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(name, '[0-9]') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(name, '[^A-Za-z0-9]') THEN 8 ELSE 0 END AS access
  FROM (SELECT entity_id, unnest(p) AS name, unnest(range(len(p))) AS i FROM (SELECT entity_id, string_split_regex(text, '[ \\n]+') AS p FROM raw)) WHERE regexp_matches(name, '[0-9]') GROUP BY entity_id, name),
mem AS (SELECT entity_id, 'm' AS kind, descr, fine, concat_ws(',', c1, c2, c3, c4, c0 - c1 - c2 - c3 - c4) AS coarse FROM lines
  UNION ALL SELECT entity_id, 'f', descr, '0', '' FROM fields),
ent AS (SELECT entity_id, lang, source,
  CAST(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END + CASE WHEN contains(text, '@') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'http') THEN 4 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 8 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 16 ELSE 0 END AS BIGINT) AS flags,
  ['S:' || lang, 'I:' || source] AS refs,
  coalesce((SELECT count(*) FROM mem m WHERE m.entity_id = r.entity_id AND kind = 'm'), 0) AS n_methods,
  coalesce((SELECT count(*) FROM mem m WHERE m.entity_id = r.entity_id AND kind = 'f'), 0) AS n_fields FROM raw r)"""

CUSTOMERS_SQL = """
mem AS (SELECT o_custkey AS entity_id, 'm' AS kind, o_orderpriority AS descr, o_orderpriority || '/' || o_orderstatus AS fine, o_orderstatus AS coarse FROM orders
  UNION ALL SELECT o_custkey, 'f', o_orderstatus, '', '' FROM orders),
sizes AS (SELECT entity_id, count(*) FILTER (kind = 'm') AS n_methods, count(*) FILTER (kind = 'f') AS n_fields FROM mem GROUP BY 1),
ent AS (SELECT c_custkey AS entity_id, c_nationkey AS nation, CAST(CASE WHEN c_mktsegment < 'B' THEN 1 WHEN c_mktsegment < 'G' THEN 3 WHEN c_mktsegment < 'I' THEN 4 ELSE 12 END AS BIGINT) AS flags,
  ['S:' || c_nationkey] AS refs, coalesce(n_methods, 0) AS n_methods, coalesce(n_fields, 0) AS n_fields FROM customer LEFT JOIN sizes ON entity_id = c_custkey)"""

#: Needs mem, ent and pairs(u, t). Gives scored(u, t, score, matched_methods, total_methods, matched_fields, total_fields).
SCORE_SQL = """
counts AS (SELECT entity_id, signal, key, count(*) AS n FROM (
  SELECT entity_id, 'fine' AS signal, descr || '#' || fine AS key FROM mem WHERE kind = 'm' UNION ALL SELECT entity_id, 'coarse', descr || '#' || coarse FROM mem WHERE kind = 'm'
  UNION ALL SELECT entity_id, 'mdesc', descr FROM mem WHERE kind = 'm' UNION ALL SELECT entity_id, 'fdesc', descr FROM mem WHERE kind = 'f') GROUP BY ALL),
tot AS (SELECT entity_id, sum(n) FILTER (signal = 'coarse') AS t_coarse, sum(n) FILTER (signal = 'mdesc') AS t_mdesc, sum(n) FILTER (signal = 'fdesc') AS t_fdesc, sum(n) FILTER (signal = 'fine') AS t_fine, count(*) FILTER (signal = 'fine') AS d_fine FROM counts GROUP BY 1),
wide AS (SELECT ent.*, coalesce(t_coarse, 0) AS t_coarse, coalesce(t_mdesc, 0) AS t_mdesc, coalesce(t_fdesc, 0) AS t_fdesc, coalesce(t_fine, 0) AS t_fine, coalesce(d_fine, 0) AS d_fine FROM ent LEFT JOIN tot USING (entity_id)),
ov AS (SELECT u, t, sum(CASE WHEN a.signal = 'fine' THEN least(a.n, b.n) ELSE 0 END) AS o_fine, sum(CASE WHEN a.signal = 'coarse' THEN least(a.n, b.n) ELSE 0 END) AS o_coarse,
  sum(CASE WHEN a.signal = 'mdesc' THEN least(a.n, b.n) ELSE 0 END) AS o_mdesc, sum(CASE WHEN a.signal = 'fdesc' THEN least(a.n, b.n) ELSE 0 END) AS o_fdesc
  FROM pairs JOIN counts a ON a.entity_id = u JOIN counts b ON b.entity_id = t AND a.signal = b.signal AND a.key = b.key GROUP BY u, t),
feat AS (SELECT p.u, p.t, coalesce(o_fine, 0) AS o_fine, coalesce(o_coarse, 0) AS o_coarse, coalesce(o_mdesc, 0) AS o_mdesc, coalesce(o_fdesc, 0) AS o_fdesc, l.* EXCLUDE (entity_id), r.* EXCLUDE (entity_id) FROM (SELECT * FROM pairs) p LEFT JOIN ov ON ov.u = p.u AND ov.t = p.t
  JOIN (SELECT entity_id, flags AS lf, refs AS lr, n_methods AS lm, n_fields AS lx, t_coarse AS lc, t_mdesc AS ld, t_fdesc AS le, t_fine AS lt, d_fine AS lk FROM wide) l ON l.entity_id = p.u
  JOIN (SELECT entity_id, flags AS rf, refs AS rr, n_methods AS rm, n_fields AS rx, t_coarse AS rc, t_mdesc AS rd, t_fdesc AS re, t_fine AS rt, d_fine AS rk FROM wide) r ON r.entity_id = p.t),
dices AS (SELECT *, CASE WHEN lk + rk = 0 THEN 1e0 ELSE 2e0 * o_fine / (lk + rk) END AS fine, CASE WHEN lt + rt = 0 THEN 1e0 ELSE 2e0 * o_fine / (lt + rt) END AS fine_multiset, CASE WHEN lc + rc = 0 THEN 1e0 ELSE 2e0 * o_coarse / (lc + rc) END AS coarse,
  CASE WHEN ld + rd = 0 THEN 1e0 ELSE 2e0 * o_mdesc / (ld + rd) END AS mdesc, CASE WHEN le + re = 0 THEN 1e0 ELSE 2e0 * o_fdesc / (le + re) END AS fdesc,
  CASE WHEN lm = 0 AND rm = 0 THEN 1e0 WHEN lm = 0 OR rm = 0 THEN 0e0 ELSE least(lm, rm)::DOUBLE / greatest(lm, rm) END AS am, CASE WHEN lx = 0 AND rx = 0 THEN 1e0 WHEN lx = 0 OR rx = 0 THEN 0e0 ELSE least(lx, rx)::DOUBLE / greatest(lx, rx) END AS ax,
  CASE WHEN (lf | rf) = 0 THEN 1e0 ELSE bit_count(lf & rf)::DOUBLE / bit_count(lf | rf) END AS acc,
  CASE WHEN len(lr) + len(rr) = 0 THEN 0.5e0 ELSE 2e0 * len(list_intersect(lr, rr)) / (len(lr) + len(rr)) END AS refd FROM feat),
scored AS (SELECT u, t, least(1e0, greatest(0e0, 0.45e0 * (0.7e0 * fine + 0.3e0 * coarse) + 0.2e0 * fdesc + 0.1e0 * mdesc + 0.1e0 * ((am + ax) / 2e0) + 0.05e0 * acc + 0.1e0 * refd)) AS score,
  CAST(o_fine AS BIGINT) AS matched_methods, CAST(greatest(lk, rk) AS BIGINT) AS total_methods, CAST(o_fdesc AS BIGINT) AS matched_fields, CAST(greatest(lx, rx) AS BIGINT) AS total_fields FROM dices)"""
