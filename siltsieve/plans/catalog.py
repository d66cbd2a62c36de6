"""The registered queries over the tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.functions import files as N
from siltsieve.functions import text as T
from siltsieve.operators import bins, documents, matching, rules
from siltsieve.sources import inventory as I
from siltsieve.streaming import alerts

NOW = "TIMESTAMP '1998-08-02 00:00:00'"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@query("""SELECT sha256(text) AS key, min(doc_id) AS keep_id, count(*) AS members, (count(*) - 1) * max(strlen(text)) AS reclaimable_bytes
FROM documents GROUP BY sha256(text) HAVING count(*) > 1""")
def dup_docs_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.duplicate_groups(I.documents(spark, sf_dir))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT doc_id, sha256(array_to_string(w, ' ')) AS key FROM w WHERE len(w) >= 20),
m AS (SELECT key, min(doc_id) AS a FROM k GROUP BY key HAVING count(*) > 1) SELECT m.a, k.doc_id AS b FROM k JOIN m USING (key) WHERE k.doc_id <> m.a""")
def docs_same_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = I.documents(spark, sf_dir).select("id", T.words(F.col("content")).alias("w")).where(F.size("w") >= 20).select("id", T.text_key(F.col("w")).alias("key"))
    return matching.same_key_pairs(units, "id", "key")


_DOC_PAIRS = rf"""d AS (SELECT doc_id, {_WORDS} AS w, CASE WHEN doc_id % 3 = 0 THEN 'notes-' || source ELSE 'notes' END AS stem FROM documents),
u AS (SELECT min(d.doc_id) AS id, any_value(w) AS w FROM d JOIN documents t ON t.doc_id = d.doc_id GROUP BY array_to_string(w, ' ') HAVING len(any_value(w)) >= 40),
s AS (SELECT u.id, u.w, list_distinct(string_split(d.stem, '-')) AS stem, list_distinct(list_transform(range(1, len(u.w) - 3), lambda i: array_to_string(u.w[i:i+4], ' '))) AS s FROM u JOIN d ON d.doc_id = u.id),
g AS (SELECT id, unnest(s) AS g FROM s), n AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
j AS (SELECT n.a, n.b, c / (len(x.s) + len(y.s) - c) AS score, x.w AS wa, y.w AS wb, x.stem AS sa, y.stem AS sb,
  list_distinct(list_filter(x.w, lambda t: len(regexp_replace(t, '[^0-9]', '', 'g')) >= 4)) AS ia, list_distinct(list_filter(y.w, lambda t: len(regexp_replace(t, '[^0-9]', '', 'g')) >= 4)) AS ib
  FROM n JOIN s x ON x.id = n.a JOIN s y ON y.id = n.b),
v AS (SELECT a, b, score, CASE WHEN score < 0.85 THEN 'similarity' WHEN least(len(wa), len(wb)) < 0.8 * greatest(len(wa), len(wb)) THEN 'length'
  WHEN NOT (list_has_all(sb, sa) OR list_has_all(sa, sb)) THEN 'names' WHEN NOT (list_has_all(ib, ia) OR list_has_all(ia, ib)) THEN 'numbers' END AS blocked FROM j WHERE score >= 0.6)"""


@query(f"WITH {_DOC_PAIRS} SELECT a, b, score, CASE WHEN blocked IS NULL THEN 'F04' ELSE 'near miss' END AS verdict, blocked FROM v")
def docs_edited_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of edited versions and near misses, with what speaks against them."""
    return documents.versions(documents.units(I.named_documents(spark, sf_dir)))


@query(f"""WITH {_DOC_PAIRS}, k AS (SELECT sha256(array_to_string(d.w, ' ')) AS key, min(d.doc_id) AS id, d.w FROM d JOIN documents t ON t.doc_id = d.doc_id WHERE len(d.w) >= 20 GROUP BY t.text, d.w),
m AS (SELECT key, min(id) AS a FROM k GROUP BY key HAVING count(*) > 1)
SELECT m.a, k.id AS b, 'F03' AS rule, 1.0::DOUBLE AS score FROM k JOIN m USING (key) WHERE k.id <> m.a UNION ALL SELECT a, b, 'F04', score FROM v WHERE blocked IS NULL""")
def docs_match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of distinct contents, each pair by its first rule."""
    return documents.edges(documents.units(I.named_documents(spark, sf_dir)))


@query()
def docs_version_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all duplicate-document groups with the kept one (complete linkage has no SQL form; a test compares with brute force)."""
    return documents.scan(I.named_documents(spark, sf_dir))


@query()
def docs_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each group, most reclaimable bytes first."""
    return documents.group_list(docs_version_groups(spark, sf_dir))


@query(r"""SELECT doc_id AS id, CASE WHEN length(text) = 0 THEN 1.0 ELSE 1 - length(regexp_replace(text, '[\p{L}\p{N}\s.,;:!?\-–—()/$€£%&@#"'']', '', 'g'))::DOUBLE / length(text) END AS share FROM documents""")
def docs_letter_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("id", T.letter_share(F.col("content")).alias("share"))


@query(rf"""SELECT doc_id AS id, len(list_distinct(list_filter({_WORDS}, lambda t: len(regexp_replace(t, '[^0-9]', '', 'g')) >= 4)))::INT AS n_identifiers FROM documents""")
def docs_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.documents(spark, sf_dir).select("id", F.size(F.array_distinct(T.identifiers(T.words(F.col("content"))))).alias("n_identifiers"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
 '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS visible FROM pages""")
def pages_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", T.visible_text(F.col("html")).alias("visible"))


@query(f"SELECT conv_id, turn, len({_WORDS})::INT AS n_words FROM conversations")
def conv_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(T.words(F.col("text"))).alias("n_words"))


@query(f"""WITH u AS (SELECT o_custkey, max(o_orderdate) AS last_used FROM orders GROUP BY 1)
SELECT c_custkey AS package, c_name AS label, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS size_bytes, last_used FROM customer LEFT JOIN u ON o_custkey = c_custkey
WHERE c_nationkey <> 0 AND (last_used IS NULL OR last_used < {NOW} - INTERVAL 90 DAY)""")
def unused_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.unused(I.apps(spark, sf_dir), F.expr(NOW)).select("package", "label", "size_bytes", "last_used")


_BIN = """b AS (SELECT o_orderkey AS id, c_name AS file_name, '/' || c_mktsegment || '/' || c_name AS original_path, o_orderpriority AS category, o_orderstatus AS reason,
 CAST(round(o_totalprice * 100) AS BIGINT) AS original_bytes, CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) // 2 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS stored_bytes,
 o_orderdate AS collected_at, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS expires_at FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"WITH {_BIN} SELECT id, file_name, original_path FROM b WHERE category = '1-URGENT' AND (contains(lower(file_name), 'auto') OR contains(lower(original_path), 'auto') OR contains(lower(reason), 'auto'))")
def bin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.search(I.bin_entries(spark, sf_dir), " AUTO ", "1-URGENT").select("id", "file_name", "original_path")


@query(f"WITH {_BIN} SELECT id, file_name, expires_at FROM b ORDER BY expires_at ASC NULLS LAST, lower(file_name), id LIMIT 100")
def bin_leaving_soonest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 entries at the top of the view that shows what leaves soonest."""
    return I.bin_entries(spark, sf_dir).orderBy(*bins.bin_order("leaving")).limit(100).select("id", "file_name", "expires_at")


@query(f"""WITH {_BIN} SELECT count(*) AS entries, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(stored_bytes) AS BIGINT) AS stored_bytes,
 CAST(sum(greatest(original_bytes - stored_bytes, 0)) AS BIGINT) AS saved_bytes, count(*) FILTER (WHERE expires_at <= {NOW} + INTERVAL 3 DAY) AS leaving_soon FROM b""")
def bin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.summary(I.bin_entries(spark, sf_dir), F.expr(NOW))


_FINDINGS = "f AS (SELECT l_returnflag AS category, l_partkey AS id, CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_linenumber = 1 AS is_kept FROM lineitem)"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as findings: category by return flag, item by part, line 1 is kept."""
    return I.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size_bytes"), (F.col("l_linenumber") == 1).alias("is_kept"))


@query(f"WITH {_FINDINGS}, o AS (SELECT category, id, max(size_bytes) AS s, count(*) AS n FROM f WHERE NOT is_kept GROUP BY 1, 2) SELECT category, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(s) AS BIGINT) AS bytes FROM o GROUP BY 1")
def reclaimable_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.reclaimable(_findings(spark, sf_dir))


@query(f"WITH {_FINDINGS}, o AS (SELECT category, id, max(size_bytes) AS size_bytes FROM f GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY size_bytes DESC, id) AS INT) AS position FROM o QUALIFY position <= 20")
def topk_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's 20 largest items of each category."""
    return bins.top_per_category(_findings(spark, sf_dir).groupBy("category", "id").agg(F.max("size_bytes").alias("size_bytes")))


@query("""SELECT o_custkey AS id, arg_min(o_orderpriority, list_position(['3-MEDIUM', '1-URGENT', '5-LOW', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority)) AS category FROM orders GROUP BY 1""")
def candidate_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("category"))
    return bins.one_candidate(items, ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"])


_CLOSE = """SELECT y.event_id AS a, x.event_id AS b, epoch_us(x.ts) - epoch_us(y.ts) AS gap_us FROM events x JOIN events y ON x.user_id = y.user_id
AND (y.ts < x.ts OR (y.ts = x.ts AND y.event_id < x.event_id)) AND x.ts <= y.ts + INTERVAL 30 MINUTE"""


@query(_CLOSE)
def shots_close_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.close_in_time(I.table(spark, sf_dir, "events"), "event_id", "ts", "user_id", 30)


@query(f"WITH p AS ({_CLOSE}) SELECT p.b AS id, arg_min(p.a, (e.value, p.a)) AS best_id FROM p JOIN events e ON e.event_id = p.a JOIN events s ON s.event_id = p.b WHERE e.value <= 0.6 * s.value GROUP BY 1")
def retake_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shot the sharpest earlier one within 30 minutes; `value` stands for the blur width."""
    events = I.table(spark, sf_dir, "events")
    pairs = shots_close_in_time(spark, sf_dir)
    e, s = events.select(F.col("event_id").alias("a"), F.col("value").alias("va")), events.select(F.col("event_id").alias("b"), F.col("value").alias("vb"))
    return pairs.join(e, "a").join(s, "b").where("va <= 0.6 * vb").groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct("va", "a")).alias("best_id"))


_HASH = """v AS (SELECT vec_id AS id, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 2] > list_sort(embedding[2:64])[32] THEN (1::HUGEINT << i)::BIGINT ELSE 0 END))::BIGINT AS h FROM embeddings),
h AS (SELECT id, h FROM v UNION ALL SELECT id + 1000000, xor(h, (1::BIGINT << (id % 63)::INT) | 17) FROM v WHERE id % 4 = 0)"""


@query(f"WITH {_HASH} SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM h x JOIN h y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 8")
def hash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as image hashes: 63 bits, one for each component (but the first) above their median; every fourth also with up to three bits flipped."""
    v = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 2, 63).alias("e"))
    v = v.withColumn("m", F.element_at(F.array_sort("e"), 32))
    bits = F.zip_with(F.sequence(F.lit(0), F.lit(62)), "e", lambda i, x: F.when(x > F.col("m"), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    v = v.select("id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)).alias("h"))
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 63).cast("int")).bitwiseOR(F.lit(17).cast("long"))
    planted = F.when(F.col("id") % 4 == 0, F.array(F.struct("id", "h"), F.struct((F.col("id") + 1_000_000).alias("id"), F.col("h").bitwiseXOR(flip).alias("h")))).otherwise(F.array(F.struct("id", "h")))
    return matching.hamming_pairs(v.select(F.inline(planted)), "id", "h", 8)


@query("SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id")
def first_seen_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return matching.first_seen(docs, ["key"], [F.col("doc_id")], "doc_id").select("doc_id", "first_id")


@query(f"""WITH x AS (SELECT o_custkey AS id, max(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 30 DAY ELSE TIMESTAMP '9999-01-01' END) AS until FROM orders GROUP BY 1)
SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM x WHERE until > {NOW})""")
def exclusions_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an active exclusion: an order excludes for 30 days, every fifth key for good."""
    until = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).otherwise(F.lit(None).cast("timestamp"))
    x = I.table(spark, sf_dir, "orders").select(F.lit("app").alias("kind"), F.col("o_custkey").alias("id"), until.alias("until"))
    return bins.not_excluded(I.table(spark, sf_dir, "customer").select(F.lit("app").alias("kind"), F.col("c_custkey").alias("id")), x, F.expr(NOW)).select("id")


@query("""SELECT event_id AS seq, CASE WHEN f < least(100 * 1073741824.0 * 0.05, 1073741824.0) THEN 'critical' WHEN f < least(100 * 1073741824.0 * 0.10, 5 * 1073741824.0) THEN 'low' ELSE 'ok' END AS level
FROM (SELECT event_id, greatest(0.0, least(value, 100.0)) / 10 * 1073741824.0 AS f FROM events)""")
def storage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.readings_of(I.table(spark, sf_dir, "events")).select("seq", "level")


@query()
def storage_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert machine over all readings of each device, in order of arrival (no SQL form)."""
    return alerts.replay(alerts.readings_of(I.table(spark, sf_dir, "events")))


@query("""SELECT doc_id, sha256(text) AS key, CAST(row_number() OVER (PARTITION BY sha256(text) ORDER BY source = 'src0', doc_id) AS INT) AS position FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text)) > 1""")
def keeper_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies ranked: those of source src0 count as second-hand, then by id."""
    found = matching.exact_groups(I.documents(spark, sf_dir))
    sizes = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    ranked = matching.keeper(found.join(sizes, "key", "left_semi").select("id", "key", "source"), "key", [F.col("source") == "src0", F.col("id")])
    return ranked.select(F.col("id").alias("doc_id"), "key", "position")


@query(r"""SELECT event_id AS id, CASE event_id % 10 WHEN 0 THEN 'E01' WHEN 1 THEN 'U06' WHEN 2 THEN 'E02' WHEN 3 THEN 'U07' END AS rule FROM events""")
def props_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text rules on the events' JSON, of which four tenths are made empty, cut off, blank or malformed."""
    k = F.col("event_id") % 10
    broken = F.when(k == 0, "").when(k == 1, F.expr("substring(props, 1, length(props) - 1)")).when(k == 2, " \n").when(k == 3, F.replace("props", F.lit(":"), F.lit(" "))).otherwise(F.col("props"))
    e = I.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), broken.alias("props"))
    return rules.judge(e, rules.text_rules(F.col("props"), F.octet_length("props"), F.lit("json"))).select("id", "rule")


@query("""WITH g AS (SELECT source, sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT key, sum(n) AS n FROM g GROUP BY 1)
SELECT CAST((SELECT sum(n * (n - 1) / 2) FROM g) AS BIGINT) AS pairs_right, CAST((SELECT sum(n * (n - 1) / 2) FROM t) AS BIGINT) AS pairs_found""")
def pair_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by content against grouping by content and source, counted in pairs from group sizes, without making the pairs."""
    docs = I.table(spark, sf_dir, "documents").groupBy("source", F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2).cast("long")
    right = docs.agg(pairs(F.col("n")).alias("pairs_right"))
    return right.crossJoin(docs.groupBy("key").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("pairs_found")))  # one row each


@query("SELECT CAST(source AS VARCHAR) AS source, count(*) AS items, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and bytes of each folder."""
    docs = I.documents(spark, sf_dir).withColumn("folder", N.folder(F.col("path")))
    return docs.groupBy(F.regexp_replace("folder", "/", "").alias("source")).agg(F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"))
