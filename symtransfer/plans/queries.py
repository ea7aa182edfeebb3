"""Registered queries over the tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TransferConfig
from ..functions import features
from ..operators import merge
from ..operators.candidates import lsh_arity_pairs, lsh_pairs, ratio_band_pairs, ratio_band_rows, ratio_band_tiles, untiled
from ..operators.lookup import map_class, map_member
from ..operators.minhash import MinHash, seeds
from ..operators.scoring import profiles, shared
from ..operators.select import with_unmatched
from ..operators.transfer import transfer_fields, transfer_methods
from ..sources.mappings import FORMATS, line_format, method_descriptor
from . import frontends
from .frontends import CUSTOMERS_SQL, DOCUMENTS_SQL, SCORE_SQL, Side, table
from .pipeline import best_near_or_similar_sizes, best_of_similar_sizes, lsh_candidates, scored_in_place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BLOCK = ["lang", "source"]
LSH = TransferConfig()
THRESHOLD = 0.55


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def micro(name: str = "score"):
    return F.floor(F.col(name) * 1e6 + 0.5).cast("long").alias(f"{name}_e6")


MICRO = "CAST(floor(score * 1e6 + 0.5e0) AS BIGINT) AS score_e6"
COUNTERS = ("matched_methods", "total_methods", "matched_fields", "total_fields")
WITHIN = "(least({a}.n_methods, {b}.n_methods) * 2 >= greatest({a}.n_methods, {b}.n_methods) AND least({a}.n_fields, {b}.n_fields) * 2 >= greatest({a}.n_fields, {b}.n_fields))".format(a="a", b="b")


# ---- documents: labelled ones are targets, the others unmapped


def _sides(spark, sf) -> tuple[Side, Side]:
    side = frontends.documents(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("entity_id"))
    return side.without(labelled), side.only(labelled)


def _words(spark, sf, labelled: bool) -> DataFrame:
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("entity_id"))
    return frontends.document_words(spark, sf, distinct=False).join(ids, "entity_id", "left_semi" if labelled else "left_anti")


DOC_PAIRS = f"""{DOCUMENTS_SQL},
pairs AS (SELECT a.entity_id AS u, b.entity_id AS t FROM ent a JOIN ent b USING (lang, source) WHERE a.entity_id NOT IN (SELECT doc_id FROM labels) AND b.entity_id IN (SELECT doc_id FROM labels) AND {WITHIN})"""
BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, t) AS rn FROM scored) WHERE rn = 1)"


@query("SELECT doc_id, lang, source, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id)")
def scan_project_targets(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "source", *long("quality", "toxic"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_unmapped(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query(f"WITH {DOCUMENTS_SQL} SELECT entity_id AS doc_id, kind, descr, CAST(count(*) AS BIGINT) AS n FROM mem GROUP BY ALL")
def member_multiset(spark, sf):
    return frontends.documents(spark, sf).member.groupBy(F.col("entity_id").alias("doc_id"), "kind", F.col("desc").alias("descr")).agg(F.count("*").alias("n"))


@query(f"WITH {CUSTOMERS_SQL} SELECT entity_id AS c_custkey, CAST(n_methods AS BIGINT) AS n_methods, CAST(n_fields AS BIGINT) AS n_fields FROM ent")
def arity_counts(spark, sf):
    return frontends.customers(spark, sf).entity.select(F.col("entity_id").alias("c_custkey"), *long("n_methods", "n_fields"))


# Opcode categories, written out for SQL.
CATEGORY_SQL = """CASE WHEN {0} BETWEEN 1 AND 18 OR {0} BETWEEN 21 AND 25 OR {0} BETWEEN 46 AND 53 OR {0} = 190 THEN 0 WHEN {0} BETWEEN 54 AND 58 OR {0} BETWEEN 79 AND 86 THEN 1
WHEN {0} BETWEEN 96 AND 152 THEN 2 WHEN {0} BETWEEN 153 AND 171 OR {0} IN (198, 199) THEN 3 WHEN {0} BETWEEN 172 AND 177 THEN 4 WHEN {0} BETWEEN 182 AND 186 THEN 5 WHEN {0} BETWEEN 178 AND 181 THEN 6
WHEN {0} IN (187, 188, 189, 192, 193) THEN 7 WHEN {0} = 191 THEN 8 WHEN {0} IN (194, 195, 197) THEN 9 ELSE 10 END"""
BODY_SQL = "body AS (SELECT p_partkey, [(p_partkey * i * 13 + p_size) % 202 FOR i IN range(1, p_size + 1)] AS ops, [p_brand, p_type] AS tags FROM part)"


def _bodies(spark, sf) -> DataFrame:
    """Parts as method bodies: opcodes computed from key and size, brand and type as operand tags."""
    ops = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: ((F.col("p_partkey") * i * 13 + F.col("p_size")) % 202).cast("int"))
    return table(spark, sf, "part").select("p_partkey", ops.alias("ops"), F.array("p_brand", "p_type").alias("tags"))


@query(f"""WITH {BODY_SQL}, c AS (SELECT p_partkey, unnest(list_transform(ops, lambda op: {CATEGORY_SQL.format('op')})) AS c FROM body)
SELECT p_partkey, concat_ws(',', {', '.join(f'count(*) FILTER (c = {i})' for i in range(11))}) AS histogram FROM c GROUP BY 1""")
def coarse_histogram(spark, sf):
    return _bodies(spark, sf).select("p_partkey", features.category_histogram(F.col("ops")).alias("histogram"))


@query(f"""WITH {BODY_SQL}, halved AS (SELECT p_partkey, list_slice(ops, 1, 1) AS ops, list_slice(tags, 1, 1) AS tags FROM body)
SELECT p_partkey, min(p_partkey) OVER (PARTITION BY ops, tags) AS first_part, CAST(count(*) OVER (PARTITION BY ops, tags) AS BIGINT) AS copies FROM halved""")
def fine_fingerprint(spark, sf):
    """Only a fingerprint's equality counts: each outline of a body with the first part that has an equal one."""
    fine = _bodies(spark, sf).select("p_partkey", features.fine_fingerprint(F.slice("ops", 1, 1), F.slice("tags", 1, 1)).alias("fine"))
    first = fine.groupBy("fine").agg(F.min("p_partkey").alias("first_part"), F.count("*").alias("copies"))
    return fine.join(first, "fine").select("p_partkey", "first_part", "copies")


@query(f"SELECT CAST(op AS BIGINT) AS op, CAST({CATEGORY_SQL.format('op')} AS BIGINT) AS category, CAST(n AS BIGINT) AS n FROM (SELECT p_size * 7 AS op, count(*) AS n FROM part GROUP BY 1)")
def opcode_categories(spark, sf):
    ops = table(spark, sf, "part").groupBy((F.col("p_size") * 7).alias("op")).agg(F.count("*").alias("n"))
    return ops.select(F.col("op").cast("long").alias("op"), features.opcode_category(F.col("op")).cast("long").alias("category"), "n")


@query("""SELECT p_partkey, CAST(floor((CASE WHEN (a | b) = 0 THEN 1e0 ELSE bit_count(a & b)::DOUBLE / bit_count(a | b) END) * 1e6 + 0.5e0) AS BIGINT) AS overlap_e6
FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS a, p_partkey % 64 AS b FROM part)""")
def flag_jaccard(spark, sf):
    overlap = features.flag_overlap(F.col("p_size"), F.col("p_partkey") % 64)
    return table(spark, sf, "part").select("p_partkey", F.floor(overlap * 1e6 + 0.5).cast("long").alias("overlap_e6"))


@query("""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'java/lang/' WHEN 1 THEN 'javax/' WHEN 2 THEN 'com/own/' ELSE 'jdk/' END || length(url) % 3 AS s, ['sun/' || page_id % 3, 'org/' || page_id % 2, 'java/io/' || length(url) % 4] AS i FROM pages),
r AS (SELECT page_id, list_distinct(list_concat(CASE WHEN regexp_matches(s, '^(java|javax|sun|com/sun|jdk)/') THEN ['S:' || s] ELSE [] END, list_transform(list_filter(i, lambda x: regexp_matches(x, '^(java|javax|sun|com/sun|jdk)/')), lambda x: 'I:' || x))) AS refs FROM n)
SELECT a.page_id, CAST(len(a.refs) AS BIGINT) AS n_refs, CAST(floor((CASE WHEN len(a.refs) + len(b.refs) = 0 THEN 0.5e0 ELSE 2e0 * len(list_intersect(a.refs, b.refs)) / (len(a.refs) + len(b.refs)) END) * 1e6 + 0.5e0) AS BIGINT) AS dice_e6 FROM r a JOIN r b ON b.page_id = a.page_id + 1""")
def ref_set_dice(spark, sf):
    pages = table(spark, sf, "pages")
    number = lambda c: c.cast("string")
    case = F.when(F.col("page_id") % 4 == 0, "java/lang/").when(F.col("page_id") % 4 == 1, "javax/").when(F.col("page_id") % 4 == 2, "com/own/").otherwise("jdk/")
    own = F.concat(case, number(F.length("url") % 3))
    others = F.array(F.concat(F.lit("sun/"), number(F.col("page_id") % 3)), F.concat(F.lit("org/"), number(F.col("page_id") % 2)), F.concat(F.lit("java/io/"), number(F.length("url") % 4)))
    refs = pages.select("page_id", features.reference_set(own, others).alias("refs"))
    after = refs.select((F.col("page_id") - 1).alias("page_id"), F.col("refs").alias("other"))
    return refs.join(after, "page_id").select("page_id", F.size("refs").cast("long").alias("n_refs"), F.floor(features.set_dice(F.col("refs"), F.col("other")) * 1e6 + 0.5).cast("long").alias("dice_e6"))


# ---- customers: even keys are targets, odd ones unmapped, within their nation

CUSTOMER_PAIRS = f"{CUSTOMERS_SQL}, pairs AS (SELECT a.entity_id AS u, b.entity_id AS t FROM ent a JOIN ent b USING (nation) WHERE a.entity_id % 2 = 1 AND b.entity_id % 2 = 0 AND {WITHIN})"


def _customer_sides(spark, sf) -> tuple[Side, Side]:
    side = frontends.customers(spark, sf)
    return side.where("entity_id % 2 = 1"), side.where("entity_id % 2 = 0")


@query(f"WITH {CUSTOMER_PAIRS} SELECT u, CAST(count(*) AS BIGINT) AS n_targets, min(t) AS first_target, max(t) AS last_target FROM pairs GROUP BY u")
def ratio_band_join(spark, sf):
    left, right = _customer_sides(spark, sf)
    return ratio_band_pairs(left.entity, right.entity, ["nation"]).groupBy("u").agg(F.count("*").alias("n_targets"), F.min("t").alias("first_target"), F.max("t").alias("last_target"))


def _dice_query(spark, sf, signal: str, denominator: str):
    left, right = _customer_sides(spark, sf)
    few = ["entity_id", "n_methods", "n_fields", "nation", f"k_{signal}", f"{denominator}_{signal}"]
    rows = ratio_band_tiles(*[profiles(x.entity, x.member, ["nation"], [signal]).select(few) for x in (left, right)], ["nation"])
    return untiled(rows.select("u", "t", features.dice(shared(signal), F.col(f"l_{denominator}_{signal}"), F.col(f"r_{denominator}_{signal}")).alias("score")).select("u", "t", micro()))


@query(f"WITH {CUSTOMER_PAIRS}, {SCORE_SQL} SELECT u, t, {MICRO} FROM (SELECT u, t, fine AS score FROM dices)")
def dice_fine_reference(spark, sf):
    return _dice_query(spark, sf, "fine", "d")


@query(f"WITH {CUSTOMER_PAIRS}, {SCORE_SQL} SELECT u, t, {MICRO} FROM (SELECT u, t, mdesc AS score FROM dices)")
def dice_multiset(spark, sf):
    return _dice_query(spark, sf, "mdesc", "t")


@query(f"WITH {CUSTOMER_PAIRS}, {SCORE_SQL} SELECT u, t, {MICRO} FROM (SELECT u, t, (am + ax) / 2e0 AS score FROM dices)")
def arity_ratio(spark, sf):
    left, right = _customer_sides(spark, sf)
    rows = ratio_band_tiles(*[s.entity.select("entity_id", "n_methods", "n_fields", "nation") for s in (left, right)], ["nation"])
    both = (features.ratio(F.col("l_n_methods"), F.col("r_n_methods")) + features.ratio(F.col("l_n_fields"), F.col("r_n_fields"))) / 2.0
    return untiled(rows.select("u", "t", both.alias("score")).select("u", "t", micro()))


@query(f"WITH {CUSTOMER_PAIRS}, {SCORE_SQL}, {BEST} SELECT u, t, {MICRO}, {', '.join(COUNTERS)} FROM best")
def customer_best_match(spark, sf):
    left, right = _customer_sides(spark, sf)
    best = best_of_similar_sizes(profiles(left.entity, left.member, ["nation"]), profiles(right.entity, right.member, ["nation"]), ["nation"])
    return best.select("u", "t", micro(), *long(*COUNTERS))


def _profiles(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Unlabelled and labelled documents' profiles. They are made before the two are told apart, so no member is joined."""
    side = frontends.documents(spark, sf)
    every = profiles(side.entity, side.member, BLOCK)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("entity_id"))
    return every.join(labelled, "entity_id", "left_anti"), every.join(labelled, "entity_id", "left_semi")


@query(f"WITH {DOC_PAIRS}, {SCORE_SQL} SELECT u, t, {MICRO}, {', '.join(COUNTERS)} FROM scored")
def weighted_score(spark, sf):
    return scored_in_place(ratio_band_rows(*_profiles(spark, sf), BLOCK)).select("u", "t", micro(), *long(*COUNTERS))


@query(f"WITH {DOC_PAIRS}, {SCORE_SQL}, {BEST} SELECT u, t, {MICRO}, {', '.join(COUNTERS)} FROM best")
def best_match_documents(spark, sf):
    return best_of_similar_sizes(*_profiles(spark, sf), BLOCK).select("u", "t", micro(), *long(*COUNTERS))


UNMATCHED_SQL = f"""WITH {DOC_PAIRS}, {SCORE_SQL}, {BEST},
rows AS (SELECT e.entity_id AS u, coalesce(b.t, e.entity_id) AS t, coalesce(b.score, 0e0) AS score, coalesce(matched_methods, 0) AS matched_methods, coalesce(total_methods, n_methods) AS total_methods,
  coalesce(matched_fields, 0) AS matched_fields, coalesce(total_fields, n_fields) AS total_fields, b.u IS NOT NULL AS matched
  FROM ent e LEFT JOIN (SELECT * FROM best WHERE score + 1e-9 >= {THRESHOLD}e0) b ON b.u = e.entity_id WHERE e.entity_id NOT IN (SELECT doc_id FROM labels))"""


def _with_unmatched(spark, sf) -> DataFrame:
    left, right = _profiles(spark, sf)
    return with_unmatched(best_of_similar_sizes(left, right, BLOCK, THRESHOLD), left, THRESHOLD)


@query(UNMATCHED_SQL + f" SELECT u, t, {MICRO}, CAST(matched_methods AS BIGINT) AS matched_methods, CAST(total_methods AS BIGINT) AS total_methods, CAST(matched_fields AS BIGINT) AS matched_fields, CAST(total_fields AS BIGINT) AS total_fields, CASE WHEN score <= 0 THEN 'Unmatched' WHEN t = u THEN 'Identity' ELSE 'Matched' END AS status FROM rows")
def threshold_match(spark, sf):
    return _with_unmatched(spark, sf).select("u", "t", micro(), *long(*COUNTERS), features.status(F.col("score"), F.col("u"), F.col("t")).alias("status"))


@query(UNMATCHED_SQL + f" SELECT u AS doc_id, {MICRO}, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, matched FROM rows LEFT JOIN labels ON matched AND doc_id = t")
def label_transfer_exact(spark, sf):
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("t"), *long("quality", "toxic"), F.lit(True).alias("matched"))
    return _with_unmatched(spark, sf).join(labels, ["t", "matched"], "left").select(F.col("u").alias("doc_id"), micro(), "quality", "toxic", "matched")


@query(UNMATCHED_SQL + " SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (matched) AS BIGINT) AS n_matched, printf('%.1f%%', 100e0 * count(*) FILTER (matched) / count(*)) AS share FROM rows")
def match_summary(spark, sf):
    out = _with_unmatched(spark, sf).agg(F.count("*").alias("n"), F.count_if("matched").alias("n_matched"))
    return out.withColumn("share", features.percent(F.col("n_matched") / F.col("n")))


# ---- MinHash and bands over words

WORDS_SQL = "words AS (SELECT DISTINCT doc_id AS entity_id, w AS element FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[ \\n]+')) AS w FROM documents) WHERE w <> '')"


def signature_sql(n: int, words: str = "words", ids: str = "(SELECT doc_id AS entity_id FROM documents)") -> str:
    slots = ", ".join(f"min(xor(h, ({s})::BIGINT)) AS s{i}" for i, s in enumerate(seeds(n)))
    return f"sig AS (SELECT entity_id, {', '.join(f'coalesce(s{i}, 0) AS s{i}' for i in range(n))} FROM {ids} LEFT JOIN (SELECT entity_id, {slots} FROM (SELECT entity_id, ('0x' || substr(md5(element), 1, 8))::BIGINT - 2147483648 AS h FROM {words}) GROUP BY 1) USING (entity_id))"


def bands_sql(n: int, bands: int) -> str:
    r = n // bands
    rows = ", ".join("{'band': " + str(b) + ", 'key': concat_ws('_', " + ", ".join(f"s{b * r + i}" for i in range(r)) + ")}" for b in range(bands))
    return f"bands AS (SELECT entity_id, x.band AS band, x.key AS key FROM (SELECT entity_id, unnest([{rows}]) AS x FROM sig))"


FULL_SQL = f"WITH {WORDS_SQL}, {signature_sql(128)}, {bands_sql(128, 32)}"


def _signatures(spark, sf) -> DataFrame:
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"))
    return MinHash(LSH.num_hashes, LSH.num_bands).signatures(frontends.document_words(spark, sf, distinct=False), ids)


def _bands(spark, sf) -> DataFrame:
    return MinHash(LSH.num_hashes, LSH.num_bands).bands(_signatures(spark, sf))


@query(f"WITH {WORDS_SQL}, {signature_sql(128)} SELECT entity_id AS doc_id, concat_ws(',', {', '.join(f's{i}' for i in range(128))}) AS sig FROM sig")
def minhash_signature(spark, sf):
    return _signatures(spark, sf).select(F.col("entity_id").alias("doc_id"), F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


@query(FULL_SQL + " SELECT entity_id AS doc_id, CAST(band AS BIGINT) AS band, key FROM bands")
def lsh_bands(spark, sf):
    r = LSH.num_hashes // LSH.num_bands
    key = F.transform(F.sequence(F.lit(0), F.lit(LSH.num_bands - 1)), lambda b: F.array_join(F.transform(F.slice("sig", b * r + 1, r), lambda x: x.cast("string")), "_"))
    return _signatures(spark, sf).select(F.col("entity_id").alias("doc_id"), F.posexplode(key).alias("band", "key")).select("doc_id", *long("band"), "key")


@query(FULL_SQL + " SELECT CAST(count(*) AS BIGINT) AS indexed, CAST(count(DISTINCT (band, key)) AS BIGINT) AS buckets FROM bands")
def bucket_stats(spark, sf):
    return MinHash(LSH.num_hashes, LSH.num_bands).stats(_bands(spark, sf))


@query(FULL_SQL + " SELECT DISTINCT a.entity_id AS u, b.entity_id AS t FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.entity_id < b.entity_id")
def lsh_candidates_documents(spark, sf):
    bands = _bands(spark, sf)
    return lsh_pairs(bands, bands).where("u < t")


LSH_PAIRS_SQL = f"""{FULL_SQL}, {DOCUMENTS_SQL},
near AS (SELECT DISTINCT x.entity_id AS u, y.entity_id AS t FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key JOIN ent a ON a.entity_id = x.entity_id JOIN ent b ON b.entity_id = y.entity_id
  WHERE x.entity_id NOT IN (SELECT doc_id FROM labels) AND y.entity_id IN (SELECT doc_id FROM labels) AND {WITHIN}),
pairs AS (SELECT u, t FROM near UNION ALL SELECT a.entity_id, b.entity_id FROM ent a JOIN ent b USING (lang, source) WHERE a.entity_id NOT IN (SELECT doc_id FROM labels) AND a.entity_id NOT IN (SELECT u FROM near) AND b.entity_id IN (SELECT doc_id FROM labels) AND {WITHIN})"""


def _lsh_pairs(spark, sf) -> tuple[DataFrame, Side, Side]:
    left, right = _sides(spark, sf)
    return lsh_candidates(left, right, _words(spark, sf, False), _words(spark, sf, True), LSH, BLOCK), left, right


@query(LSH_PAIRS_SQL + " SELECT u, CAST(count(*) AS BIGINT) AS n, min(t) AS first_target FROM pairs GROUP BY u")
def lsh_fallback(spark, sf):
    return _lsh_pairs(spark, sf)[0].groupBy("u").agg(F.count("*").alias("n"), F.min("t").alias("first_target"))


@query(LSH_PAIRS_SQL + f", {SCORE_SQL}, {BEST} SELECT b.u AS doc_id, t, {MICRO}, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM best b JOIN labels ON doc_id = t WHERE score + 1e-9 >= {THRESHOLD}e0")
def label_transfer_lsh(spark, sf):
    left, right = _profiles(spark, sf)
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("entity_id"))
    signatures, lsh = _signatures(spark, sf), MinHash(LSH.num_hashes, LSH.num_bands)
    bands = [lsh.bands(signatures.join(labelled, "entity_id", how)) for how in ("left_anti", "left_semi")]
    best = best_near_or_similar_sizes(*bands, left, right, BLOCK, THRESHOLD)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("t"), *long("quality", "toxic"))
    return best.join(labels, "t").select(F.col("u").alias("doc_id"), "t", micro(), "quality", "toxic")


def _sketched(hashed: DataFrame, longs: int) -> DataFrame:
    """entity_id, n (hashes), b0 ... (a bit for each), x (hashes beyond one for each bit). hashed: entity_id, h."""
    bits = [F.expr(f"aggregate(filter(h, x -> ((x >> 6) & {longs - 1}) = {i}), 0L, (a, x) -> a | shiftleft(1L, cast(x & 63 as int)))").alias(f"b{i}") for i in range(longs)]
    rows = hashed.select("entity_id", F.size("h").alias("n"), *bits)
    return rows.withColumn("x", F.col("n") - F.expr(" + ".join(f"bit_count(b{i})" for i in range(longs))))


def _may_share_half(longs: int) -> str:
    """Of the shared hashes no more than one for each shared bit and the smaller number of others can be."""
    return "3 * (" + " + ".join(f"bit_count(l_b{i} & r_b{i})" for i in range(longs)) + " + least(l_x, r_x)) >= l_n + r_n"


def _word_sets(texts: DataFrame) -> DataFrame:
    """entity_id, h: the 64-bit hashes of an entity's different words; entities without words are not in it. texts: entity_id, text.

    Words become hashes where their text is read, so hashes alone are shuffled. An entity in several rows has the words of all.
    """
    words = F.array_distinct(F.filter(F.split("text", "[ \n]+"), lambda x: x != ""))
    # the first 16 digits of the MD5: half of them is what MinHash takes
    rows = texts.where("entity_id IS NOT NULL").select("entity_id", F.transform(words, lambda x: F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("long")).alias("h"))
    rows = rows.where("size(h) > 0").repartition("entity_id")
    return rows.groupBy("entity_id").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("h"))


def _near_duplicates(texts: DataFrame) -> DataFrame:
    """u, t, shared, total: pairs of representatives that share a band and half their words, and each copy with its representative.

    Only one entity of those with equal word sets reaches the bands, so copies make no pairs among themselves. A sketch
    of each set goes with its bands and bounds what two sets share, so only pairs that may be similar are shuffled;
    these are compared on the sets' 64-bit hashes.
    """
    sets = _word_sets(texts)
    copies = sets.select("entity_id", F.sha2(F.array_join(F.transform(F.sort_array("h"), lambda x: x.cast("string")), ","), 256).alias("key"), F.size("h").cast("long").alias("n"))
    least = copies.groupBy("key").agg(F.min("entity_id").alias("rep"))
    hashed = sets.join(least.select(F.col("rep").alias("entity_id")), "entity_id", "left_semi")
    lsh = MinHash(LSH.num_hashes, LSH.num_bands)
    bands = lsh.bands(lsh.signatures_of_hashes(hashed.select("entity_id", F.explode("h").alias("h")).select("entity_id", (F.shiftrightunsigned("h", 32) - F.lit(2147483648)).alias("h"))))
    # most buckets have one entity, and go before sketches are sent
    within = Window.partitionBy("band", "band_hash")
    bands = bands.withColumns({"low": F.min("entity_id").over(within), "high": F.max("entity_id").over(within)}).where("low != high").drop("low", "high")
    met = bands.join(_sketched(hashed, 8), "entity_id")
    named = lambda df, own, m: df.select(F.col("entity_id").alias(own), *[F.col(c).alias(c if c[:4] == "band" else m + c) for c in df.columns if c != "entity_id"])
    pairs = named(met, "u", "l_").join(named(met, "t", "r_"), ["band", "band_hash"]).where("u < t").where(_may_share_half(8)).select("u", "t").distinct()
    # a longer sketch for each pair, before whole sets are sent
    longer = _sketched(hashed, 32)
    pairs = pairs.join(named(longer, "u", "l_"), "u").join(named(longer, "t", "r_"), "t").where(_may_share_half(32)).select("u", "t")
    both = pairs.join(hashed.select(F.col("entity_id").alias("u"), F.col("h").alias("x")), "u").join(hashed.select(F.col("entity_id").alias("t"), F.col("h").alias("y")), "t")
    both = both.select("u", "t", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.size("x") + F.size("y")).alias("n"))
    both = both.select("u", "t", "shared", (F.col("n") - F.col("shared")).cast("long").alias("total")).where("10 * shared >= 5 * total")
    return both.unionByName(copies.join(least, "key").where("entity_id != rep").select(F.col("rep").alias("u"), F.col("entity_id").alias("t"), F.col("n").alias("shared"), F.col("n").alias("total")))


CLASSES_SQL = """cls AS (SELECT entity_id, n, min(entity_id) OVER (PARTITION BY key) AS rep FROM (SELECT entity_id, count(*) AS n, string_agg(element, chr(10) ORDER BY element) AS key FROM words GROUP BY 1))"""
NEAR_SQL = CLASSES_SQL + """
SELECT u, t, CAST(shared AS BIGINT) AS shared, CAST(total AS BIGINT) AS total FROM k JOIN near USING (u, t) WHERE 10 * shared >= 5 * total AND u IN (SELECT rep FROM cls) AND t IN (SELECT rep FROM cls)
UNION ALL SELECT rep, entity_id, n, n FROM cls WHERE rep <> entity_id"""


RECALL_SQL = FULL_SQL + """, n AS (SELECT entity_id, count(*) AS n FROM words GROUP BY 1),
near AS (SELECT DISTINCT a.entity_id AS u, b.entity_id AS t FROM bands a JOIN bands b ON a.band = b.band AND a.key = b.key AND a.entity_id < b.entity_id),
j AS (SELECT a.entity_id AS u, b.entity_id AS t, count(*) AS shared FROM words a JOIN words b ON a.element = b.element AND a.entity_id < b.entity_id GROUP BY ALL),
k AS (SELECT u, t, shared, x.n + y.n - shared AS total FROM j JOIN n x ON x.entity_id = u JOIN n y ON y.entity_id = t)"""


@query(RECALL_SQL + ", " + NEAR_SQL)
def near_dup_documents(spark, sf):
    return _near_duplicates(table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), "text"))


LINE_SETS_SQL = "words AS (SELECT DISTINCT doc_id AS entity_id, w AS element FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS w FROM documents) WHERE trim(w) <> '')"


@query(f"""WITH {LINE_SETS_SQL}, {signature_sql(128)}, {bands_sql(128, 32)}""" + RECALL_SQL[len(FULL_SQL) :] + """
SELECT CAST(10 * shared // total AS BIGINT) AS decile, CAST(count(*) AS BIGINT) AS pairs, CAST(count(near.u) AS BIGINT) AS found FROM k LEFT JOIN near USING (u, t) WHERE 2 * shared >= total GROUP BY 1""")
def lsh_recall(spark, sf):
    """Of document pairs whose sets of lines are similar by half or more, by decile: all, and those that the bands find.

    The exact pairs come from a prefix filter: with lines in order of frequency, two such sets share one of each other's
    first n - ceil(n / 2) + 1 lines, so frequent lines are hardly ever joined.
    """
    lines = frontends.document_lines(table(spark, sf, "documents")).select("entity_id", F.col("name").alias("element")).distinct()
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"))
    lsh = MinHash(LSH.num_hashes, LSH.num_bands)
    bands = lsh.bands(lsh.signatures(lines, ids))
    found = lsh_pairs(bands, bands).where("u < t").withColumn("hit", F.lit(1))
    seen = lines.join(lines.groupBy("element").agg(F.count("*").alias("df")), "element")
    sets = seen.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("df", "element"))).alias("s"))
    sets = sets.select("entity_id", F.transform("s", lambda x: x["element"]).alias("s"), F.size("s").alias("n"))
    prefix = sets.select("entity_id", F.explode(F.slice("s", F.lit(1), F.expr("n - cast(ceil(n / 2.0) as int) + 1"))).alias("element"))
    pairs = prefix.withColumnRenamed("entity_id", "u").join(prefix.withColumnRenamed("entity_id", "t"), "element").where("u < t").select("u", "t").distinct()
    both = pairs.join(sets.select(F.col("entity_id").alias("u"), F.col("s").alias("x")), "u").join(sets.select(F.col("entity_id").alias("t"), F.col("s").alias("y")), "t")
    shared = F.size(F.array_intersect("x", "y"))
    exact = both.select("u", "t", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("total")).where("2 * shared >= total")
    return exact.join(found, ["u", "t"], "left").groupBy(F.expr("10 * shared div total").cast("long").alias("decile")).agg(F.count("*").alias("pairs"), F.count("hit").alias("found"))


# ---- transfer and lookup

TRANSFER_MATCH_SQL = "m AS (SELECT o_orderkey AS u, o_orderkey - 1 AS t FROM orders WHERE o_orderkey - 1 IN (SELECT o_orderkey FROM orders) AND o_orderkey % 2 = 0)"


def _order_matches(spark, sf) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey")
    return orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("u"), (F.col("o_orderkey") - 1).alias("t")).join(orders.withColumnRenamed("o_orderkey", "t"), "t", "left_semi")


def _line_members(spark, sf) -> DataFrame:
    """Lines of orders, numbered; a line number may repeat."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return table(spark, sf, "lineitem").withColumn("ord", F.row_number().over(order).cast("long"))


LINES_SQL = "li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS ord FROM lineitem)"


@query(f"""WITH {TRANSFER_MATCH_SQL}, {LINES_SQL},
k AS (SELECT l_orderkey AS t, l_returnflag AS d, l_linestatus AS f, arg_max('n' || l_partkey, ord) AS nm FROM li GROUP BY ALL)
SELECT m.u, CAST(li.ord AS BIGINT) AS ord, coalesce(k.nm, 'p' || li.l_suppkey) AS to_name FROM m JOIN li ON li.l_orderkey = m.u LEFT JOIN k ON k.t = m.t AND k.d = li.l_returnflag AND k.f = li.l_linestatus""")
def member_transfer_last_wins(spark, sf):
    lines = _line_members(spark, sf)
    side = lambda name: lines.select(F.col("l_orderkey").alias("entity_id"), "ord", name.alias("name"), F.col("l_returnflag").alias("desc"), F.col("l_linestatus").alias("fine"))
    left = side(F.concat(F.lit("p"), F.col("l_suppkey").cast("string")))
    right = side(F.concat(F.lit("n"), F.col("l_partkey").cast("string"))).withColumn("to_name", F.lit(None).cast("string"))
    return transfer_methods(_order_matches(spark, sf), left, right).select("u", "ord", "to_name")


@query(f"""WITH RECURSIVE {TRANSFER_MATCH_SQL}, {LINES_SQL},
x AS (SELECT l_orderkey AS e, l_returnflag AS d, ord, CAST(l_quantity AS INTEGER) % 3 AS a, l_partkey % 2 AS i, 'n' || l_partkey || '.' || ord AS nm, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY ord) AS k FROM li),
q AS (SELECT e, d, list({{'o': ord, 'a': a, 'i': i, 'nm': nm}} ORDER BY ord) AS q FROM x GROUP BY ALL),
f(u, t, d, k, q, o, to_name) AS (
  SELECT m.u, m.t, p.d, CAST(0 AS BIGINT), coalesce(q.q, []), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM m JOIN (SELECT DISTINCT e, d FROM x) p ON p.e = m.u LEFT JOIN q ON q.e = m.t AND q.d = p.d
  UNION ALL
  SELECT u, t, d, k + 1, CASE WHEN b IS NULL THEN q ELSE list_filter(q, lambda c: c.o <> b.o) END, ord, coalesce(b.nm, nm)
  FROM (SELECT f.u, f.t, f.d, f.k, f.q, x.ord, x.nm, coalesce(list_filter(f.q, lambda c: c.a = x.a AND c.i = x.i AND x.a <> 0)[1], list_filter(f.q, lambda c: c.a = x.a AND x.a <> 0)[1], f.q[1]) AS b FROM f JOIN x ON x.e = f.u AND x.d = f.d AND x.k = f.k + 1))
SELECT u, CAST(o AS BIGINT) AS ord, d AS descr, to_name FROM f WHERE o IS NOT NULL""")
def greedy_assignment(spark, sf):
    lines = _line_members(spark, sf)
    name = F.concat(F.lit("n"), F.col("l_partkey").cast("string"), F.lit("."), F.col("ord").cast("string"))
    side = lines.select(F.col("l_orderkey").alias("entity_id"), "ord", name.alias("name"), F.col("l_returnflag").alias("desc"), (F.col("l_quantity").cast("int") % 3).alias("access"), (F.col("l_partkey") % 2).cast("int").alias("init_tag"))
    out = transfer_fields(_order_matches(spark, sf), side, side.withColumnRenamed("name", "to_name"))
    return out.select("u", "ord", F.col("desc").alias("descr"), "to_name")


@query("""WITH known AS (SELECT p_brand AS o, p_type AS n, CAST(p_size AS VARCHAR) AS d, min(p_name || '#' || p_partkey) AS v FROM part GROUP BY ALL),
only1 AS (SELECT o, n, max(v) AS v FROM known GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, p_brand AS o, p_type AS n, CAST(p_size + l_linenumber % 2 AS VARCHAR) AS d FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, coalesce(known.v, only1.v, q.n) AS mapped FROM q LEFT JOIN known USING (o, n, d) LEFT JOIN only1 USING (o, n)""")
def lookup_exact_or_unique(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    members = part.groupBy(F.col("p_brand").alias("from_class"), F.lit("m").alias("kind"), F.col("p_type").alias("from_name"), size.alias("desc")).agg(F.min(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string"))).alias("to_name"))
    asked = table(spark, sf, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    asked = asked.select("l_orderkey", *long("l_linenumber"), "l_partkey", "l_suppkey", F.col("p_brand").alias("owner"), F.lit("m").alias("kind"), F.col("p_type").alias("name"), (F.col("p_size") + F.col("l_linenumber") % 2).cast("string").alias("desc"))
    return map_member(asked, members).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "mapped")


@query("SELECT n_name, coalesce(r_name, n_name) AS mapped FROM nation LEFT JOIN region ON r_name = CASE WHEN n_regionkey < 3 THEN (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) END")
def lookup_self_default(spark, sf):
    regions = table(spark, sf, "region").where("r_regionkey < 3")
    known = table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("from_name"), F.col("r_name").alias("to_name"))
    return map_class(table(spark, sf, "nation").select("n_name"), known, "n_name")


@query(UNMATCHED_SQL + ", o AS (SELECT doc_id, nullif(trim(CASE doc_id % 3 WHEN 0 THEN ' a.b' || doc_id || ' ' WHEN 1 THEN '  ' END), '') AS name FROM documents) SELECT u AS doc_id, CASE WHEN matched THEN CAST(t AS VARCHAR) ELSE coalesce(replace(o.name, '.', '/'), CAST(u AS VARCHAR)) END AS to_name, CASE WHEN matched THEN 'match' WHEN o.name IS NOT NULL THEN 'override' ELSE 'identity' END AS source FROM rows LEFT JOIN o ON o.doc_id = u")
def priority_merge(spark, sf):
    rows = _with_unmatched(spark, sf)
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" a.b"), F.col("doc_id").cast("string"), F.lit(" "))).when(F.col("doc_id") % 3 == 1, "  ")
    overrides = table(spark, sf, "documents").select(F.col("doc_id").alias("entity_id"), given.alias("name"))
    out = merge.named(rows.select(F.col("u").alias("entity_id")), rows.where("matched").select(F.col("u").alias("entity_id"), F.col("t").cast("string").alias("name")), overrides)
    return out.select(F.col("entity_id").alias("doc_id"), "to_name", "source")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(props, event_id) AS props, min(event_id) AS first_event FROM events GROUP BY ALL")
def upsert_last_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("at"), "event_id", "props")
    return merge.last_wins(events, ["user_id", "event_type"], "at", "first_event").select("user_id", "event_type", "event_id", "props", "first_event")


@query("""WITH last AS (SELECT user_id, max(event_id) AS reset FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT e.event_id, e.user_id FROM events e LEFT JOIN last l USING (user_id) WHERE event_type <> 'purchase' AND (reset IS NULL OR event_id > reset)""")
def upsert_reset_members(spark, sf):
    events = table(spark, sf, "events")
    classes = events.where("event_type = 'purchase'").select(F.col("user_id").alias("from_name"), F.col("event_id").alias("ord"))
    members = events.where("event_type != 'purchase'").select(F.col("user_id").alias("from_class"), F.col("event_id").alias("ord"))
    return merge.reset_members(classes, members).select(F.col("ord").alias("event_id"), F.col("from_class").alias("user_id"))


@query("SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations")
def ordered_carry_down(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(order)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", carried.alias("last_user_turn"))


@query(r"""WITH t AS (SELECT event_id, x FROM (SELECT event_id, unnest([event_type, CAST(CAST(event_id AS BIGINT) - 50 AS VARCHAR), CASE event_id % 4 WHEN 0 THEN '(I)V' WHEN 1 THEN 'J' WHEN 2 THEN '[I' ELSE 'Jx' END]) AS x FROM events))
SELECT event_id, x AS token, regexp_matches(x, '^[(\[L]') OR regexp_matches(x, '^[IJSBCZFDV]$') AS is_descriptor, regexp_matches(x, '^-?[0-9]+$') AS is_integer FROM t""")
def row_kind_dispatch(spark, sf):
    shape = F.when(F.col("event_id") % 4 == 0, "(I)V").when(F.col("event_id") % 4 == 1, "J").when(F.col("event_id") % 4 == 2, "[I").otherwise("Jx")
    tokens = table(spark, sf, "events").select("event_id", F.explode(F.array("event_type", (F.col("event_id") - 50).cast("string"), shape)).alias("token"))
    return tokens.select("event_id", "token", features.looks_like_descriptor(F.col("token")).alias("is_descriptor"), features.looks_like_integer(F.col("token")).alias("is_integer"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/([^/]*)$', 1) AS owner, regexp_extract(url, '^(.*)/([^/]*)$', 2) AS member FROM pages")
def qualified_split(spark, sf):
    from ..sources.mappings import owner_and_member

    owner, member = owner_and_member(F.col("url"))
    return table(spark, sf, "pages").select("page_id", owner.alias("owner"), member.alias("member"))


_JAVA_TYPES = {"int": "I", "long": "J", "byte": "B", "boolean": "Z", "java.lang.String": "Ljava/lang/String;", "java.util.Map": "Ljava/util/Map;", "p.C": "Lp/C;"}
_TYPE_LIST = list(_JAVA_TYPES)


@query(f"""WITH t AS (SELECT p_partkey, list_value({", ".join(f"'{x}'" for x in _JAVA_TYPES.values())}) AS d, CAST(p_partkey % 7 AS INTEGER) AS a, CAST(p_size % 7 AS INTEGER) AS b, CAST((p_partkey // 7) % 3 AS INTEGER) AS k FROM part)
SELECT p_partkey, '(' || CASE WHEN k > 0 THEN d[a + 1] ELSE '' END || CASE WHEN k > 1 THEN '[' || d[b + 1] ELSE '' END || ')' || CASE WHEN k = 0 THEN 'V' ELSE d[b + 1] END AS descr FROM t""")
def descriptor_synthesis(spark, sf):
    types = F.array(*[F.lit(t) for t in _TYPE_LIST])
    a, b = (F.element_at(types, (c % 7 + 1).cast("int")) for c in (F.col("p_partkey"), F.col("p_size")))
    k = F.expr("p_partkey div 7") % 3
    args = F.when(k == 0, F.lit("()")).when(k == 1, F.concat(F.lit("("), a, F.lit(")"))).otherwise(F.concat(F.lit("("), a, F.lit(","), b, F.lit("[])")))
    return table(spark, sf, "part").select("p_partkey", method_descriptor(F.when(k == 0, F.lit("void")).otherwise(b), args).alias("descr"))


@query("""SELECT line FROM (SELECT 'c' || chr(9) || r_name || chr(9) || CASE WHEN r_regionkey % 2 = 0 THEN replace(r_name, 'A', chr(92) || 't') ELSE r_name END AS line FROM region
UNION ALL SELECT chr(9) || 'm' || chr(9) || n_name || chr(9) || '()V' || chr(9) || lower(n_name) FROM nation)""")
def tiny_render(spark, sf):
    from ..sinks.tiny import class_line, member_line

    region = table(spark, sf, "region")
    to = F.when(F.col("r_regionkey") % 2 == 0, F.replace("r_name", F.lit("A"), F.lit("\t"))).otherwise(F.col("r_name"))
    nation = table(spark, sf, "nation")
    lines = region.select(class_line(F.col("r_name"), to).alias("line"))
    return lines.unionByName(nation.select(member_line(F.lit("m"), F.col("n_name"), F.lit("()V"), F.lower("n_name")).alias("line")))


_HEADS = {0: "tiny\t2\t0\ta\tb", 1: "tiny\t1\ta\tb", 2: "tsrg2 a b", 3: "a\tb", 4: "CL: a b", 5: "# mapping file", 6: "nothing"}


@query("SELECT doc_id, ['tiny-v2', 'tiny-v1', 'tsrg-v2', 'tsrg-v1', 'srg', 'mojang', NULL][CAST(doc_id % 7 AS INTEGER) + 1] AS format FROM documents")
def format_sniff(spark, sf):
    heads = F.array(*[F.lit(_HEADS[i]) for i in range(7)])
    first = F.element_at(heads, (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", line_format(F.array(first)).alias("format"))


# ---- other tables through the same operators


def _shared_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """u, t, shared: through an equi-join on words that few right entities have."""
    return left.select(F.col("entity_id").alias("u"), "element").join(right.select(F.col("entity_id").alias("t"), "element"), "element").groupBy("u", "t").agg(F.count("*").alias("shared"))


@query("""WITH g AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM benchmark))),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents))),
s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN g USING (g) GROUP BY ALL)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, item_id) AS rn FROM s) WHERE rn = 1""")
def contamination_match(spark, sf):
    """The benchmark item that shares most eight-word runs with each document."""

    def runs(name, key):
        words = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
        rows = table(spark, sf, name).select(F.col(key).alias("entity_id"), words.alias("w")).where("size(w) >= 8")
        return rows.select("entity_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))).alias("element"))

    # of the documents' runs only those that the benchmark has are made distinct
    wanted = runs("benchmark", "item_id").distinct()
    met = runs("documents", "doc_id").join(wanted.select("element").distinct(), "element", "left_semi").distinct()
    shared = _shared_words(met, wanted)
    best = shared.groupBy("u").agg(F.min_by(F.struct("t", "shared"), F.struct(-F.col("shared"), F.col("t"))).alias("b"))
    return best.select(F.col("u").alias("doc_id"), F.col("b.t").alias("item_id"), F.col("b.shared").alias("shared"))


@query("""WITH c AS (SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn, role, text)) AS h, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, min(conv_id) OVER (PARTITION BY h) AS first_conv, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS copies FROM c""")
def conversation_match(spark, sf):
    """Each conversation with the first one of the same turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(body).alias("h"), F.count("*").alias("n_turns"))
    first = c.groupBy("h").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("copies"))
    return c.join(first, "h").select("conv_id", "n_turns", "first_conv", "copies")


PAGE_WORDS_SQL = "words AS (SELECT DISTINCT page_id AS entity_id, w AS element FROM (SELECT page_id, unnest(string_split_regex(coalesce(html, ''), '[ \\n]+')) AS w FROM pages) WHERE w <> '')"


@query(f"WITH {PAGE_WORDS_SQL}, {signature_sql(128, ids='(SELECT page_id AS entity_id FROM pages)')}, {bands_sql(128, 32)}" + RECALL_SQL[len(FULL_SQL) :] + ", " + NEAR_SQL)
def page_dup_match(spark, sf):
    return _near_duplicates(table(spark, sf, "pages").select(F.col("page_id").alias("entity_id"), F.col("html").alias("text")))


@query(LSH_PAIRS_SQL + " SELECT u, t FROM near")
def lsh_arity_join(spark, sf):
    left, right = _sides(spark, sf)
    lsh = MinHash(LSH.num_hashes, LSH.num_bands)
    bands = [lsh.bands(lsh.signatures(_words(spark, sf, labelled), side.entity)) for labelled, side in ((False, left), (True, right))]
    return lsh_arity_pairs(*bands, left.entity, right.entity)


assert set(FORMATS) == {"tiny-v2", "tiny-v1", "tsrg-v2", "tsrg-v1", "srg", "mojang"}
