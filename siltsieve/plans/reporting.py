"""Queries of state changes, reports, names, videos and groups over the tables, each with its DuckDB SQL. Mappings are synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltsieve.functions import names as M
from siltsieve.functions import text as T
from siltsieve.operators import health, photos, reports, state, videos
from siltsieve.plans.catalog import _BIN, NOW, query
from siltsieve.sources import inventory as I
from siltsieve.sources import listing


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as findings: category by line number, finding by order, item by part; the smallest line of an order is kept."""
    li = I.table(spark, sf_dir, "lineitem")
    category = F.element_at(F.array(*(F.lit(c) for c in reports.CATEGORIES)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    return li.select(category.alias("category"), F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size_bytes"), (F.col("l_linenumber") == 1).alias("is_kept"), F.lit("reason").alias("reason"))


_F = "f AS (SELECT (['emptyFile', 'unreadableFile', 'duplicatePhoto', 'blankPhoto', 'unusedApp'])[l_orderkey % 4 + 1] AS category, l_orderkey AS finding, l_partkey AS id, CAST(round(l_extendedprice * 100) AS BIGINT) AS size_bytes, l_linenumber = 1 AS is_kept FROM lineitem)"


@query(f"""WITH {_F}, c AS (SELECT unnest(['emptyFile', 'unreadableFile', 'duplicatePhoto', 'blankPhoto', 'unusedApp']) AS category),
o AS (SELECT category, id, max(size_bytes) FILTER (WHERE NOT is_kept) AS s FROM f GROUP BY 1, 2), b AS (SELECT category, sum(s) AS bytes FROM o GROUP BY 1), n AS (SELECT category, count(DISTINCT finding) AS findings FROM f GROUP BY 1)
SELECT category, coalesce(findings, 0) AS findings, CAST(coalesce(bytes, 0) AS BIGINT) AS bytes FROM c LEFT JOIN n USING (category) LEFT JOIN b USING (category)""")
def report_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every category, zeros included."""
    return reports.by_category(_findings(spark, sf_dir))


@query(f"WITH {_F}, o AS (SELECT id, max(size_bytes) AS s FROM f WHERE NOT is_kept GROUP BY 1) SELECT count(*) AS items, CAST(sum(s) AS BIGINT) AS bytes FROM o")
def report_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overall(_findings(spark, sf_dir))


@query(f"WITH {_F} SELECT category, finding, CAST(coalesce(sum(size_bytes) FILTER (WHERE NOT is_kept), 0) AS BIGINT) AS bytes, coalesce(min(id) FILTER (WHERE is_kept), -1) AS keep_id, count(*) AS items, 'reason' AS reason FROM f GROUP BY 1, 2")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, most removable bytes first."""
    return reports.finding_list(_findings(spark, sf_dir)).withColumn("keep_id", F.coalesce("keep_id", F.lit(-1)))


@query("SELECT count(*) AS items, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(DISTINCT source) AS folders FROM documents")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(I.documents(spark, sf_dir))


@query(f"""WITH {_BIN}, s AS (SELECT id, collected_at, original_bytes AS n, expires_at, date_diff('day', collected_at::DATE, ({NOW})::DATE) AS d, epoch_us(expires_at) - epoch_us({NOW}) AS l FROM b),
v AS (SELECT *, CASE WHEN n < 1000 THEN 0 WHEN n < 999500 THEN 1 WHEN n < 999500000 THEN 2 WHEN n < 999500000000 THEN 3 ELSE 4 END AS u FROM s),
t AS (SELECT *, n / pow(1000, u) AS x FROM v)
SELECT id, CASE WHEN u = 0 THEN n || ' B' ELSE regexp_replace(CASE WHEN x >= 100 THEN printf('%.0f', x) ELSE printf('%.1f', x) END, '\\.0$', '') || ' ' || (['KB', 'MB', 'GB', 'TB'])[u] END AS size,
 CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(collected_at, '%b %-d, %Y') END AS collected,
 CASE WHEN l <= 0 THEN 'Due for removal' WHEN l < 86400000000 THEN 'Less than a day left' WHEN l // 86400000000 = 1 THEN '1 day left' ELSE (l // 86400000000) || ' days left' END AS left_label FROM t""")
def bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bin's list says of each entry."""
    b = I.bin_entries(spark, sf_dir)
    return b.select("id", reports.decimal_bytes(F.col("original_bytes")).alias("size"), reports.collected_label(F.col("collected_at"), F.expr(NOW)).alias("collected"), reports.time_left_label(F.col("expires_at"), F.expr(NOW)).alias("left_label"))


@query("""SELECT priority || ' (' || n || ')' AS label, bytes FROM (SELECT o_orderpriority AS priority, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1)""")
def collection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.collection_rows(I.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reason"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes")))


@query("""WITH r AS (SELECT o_orderpriority AS label, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS bytes FROM orders GROUP BY 1 UNION ALL SELECT 'Unused apps', sum(CAST(round(abs(c_acctbal) * 100) AS BIGINT)) FROM customer)
SELECT label, CAST(bytes AS BIGINT) AS bytes, CAST((SELECT sum(bytes) FROM r) AS BIGINT) AS wasted, 0.75::DOUBLE AS used_fraction FROM r""")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reason"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"))
    return reports.results_page(orders, I.apps(spark, sf_dir), spark.createDataFrame([(25, 100)], "free long, total long"))


def _exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer as an exclusion for 30 days, every fifth customer's for good."""
    o = I.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("excluded_at"))
    return o.select(F.lit("file").alias("kind"), F.col("o_custkey").alias("id"), F.col("excluded_at").cast("timestamp").alias("excluded_at"), F.when(F.col("o_custkey") % 5 != 0, F.col("excluded_at").cast("timestamp") + F.expr("INTERVAL 30 DAYS")).alias("until"), F.lit(None).cast("string").alias("label"))


_X = "x AS (SELECT 'file' AS kind, o_custkey AS id, max(o_orderdate) AS excluded_at, CASE WHEN o_custkey % 5 <> 0 THEN max(o_orderdate) + INTERVAL 30 DAY END AS until FROM orders GROUP BY o_custkey)"


@query(f"""WITH {_X}, n AS (SELECT 'file' AS kind, c_custkey AS id, {NOW} AS excluded_at, {NOW} + INTERVAL 30 DAY AS until FROM customer WHERE c_nationkey < 5)
SELECT id, epoch_us(excluded_at) AS excluded_us, coalesce(epoch_us(until), -1) AS until_us FROM (SELECT * FROM n UNION ALL SELECT * FROM x WHERE id NOT IN (SELECT id FROM n)) WHERE until IS NULL OR until > {NOW}""")
def exclusions_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions after customers of five nations were excluded anew and ended ones were purged, in the order of the list."""
    items = I.table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.lit("file").alias("kind"), F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("label"))
    return state.active(state.exclude(_exclusions(spark, sf_dir), items, F.expr(NOW)), F.expr(NOW)).select("id", F.unix_micros("excluded_at").alias("excluded_us"), F.coalesce(F.unix_micros("until"), F.lit(-1)).alias("until_us"))


@query(f"""WITH {_X}, b AS (SELECT o_orderkey AS id, o_orderpriority AS reason, epoch_us(o_orderdate) AS t FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, reason, t AS collected_us FROM b UNION ALL SELECT c_custkey, 'manual', epoch_us({NOW}) FROM customer WHERE c_custkey NOT IN (SELECT id FROM b)""")
def bin_after_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin (orders with even keys) after customers were collected by hand."""
    b = I.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").cast("timestamp").alias("collected_at"))
    items = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("reason"))
    return state.collect(b, _exclusions(spark, sf_dir), items, F.expr(NOW))[0].select("id", "reason", F.unix_micros("collected_at").alias("collected_us"))


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE NOT (o_orderstatus = 'F' OR c_nationkey = 3)")
def bin_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries left after all were to be deleted: the device removed those of status F, those of nation 3 were missing."""
    o = I.table(spark, sf_dir, "orders").join(I.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "o_orderstatus", "c_nationkey")
    return state.delete(o.select("id"), o, o.where("o_orderstatus = 'F'"), o.where("c_nationkey = 3"))[0]


@query("SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 1 WHERE c_custkey IS NULL")
def bin_missing_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose asset (the next customer) is not there."""
    o = I.table(spark, sf_dir, "orders").select((F.col("o_custkey") + 1).alias("id"), F.col("o_orderkey").alias("entry"))
    gone = state.present(o, I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"))[1]
    return o.join(gone, "id", "left_semi").select(F.col("entry").alias("id"))


@query("SELECT bin_category AS category, count(*) AS items, count(*) FILTER (WHERE bin_category IN ('document', 'other') AND ext NOT IN ('zip', 'docx')) AS worth FROM (SELECT ext, CASE ext WHEN 'jpg' THEN 'photo' WHEN 'mp4' THEN 'video' WHEN 'mp3' THEN 'audio' WHEN 'apk' THEN 'app' WHEN 'zip' THEN 'other' ELSE 'document' END AS bin_category FROM (SELECT (['jpg', 'mp4', 'mp3', 'apk', 'zip', 'docx', 'txt'])[o_orderkey % 7 + 1] AS ext FROM orders)) GROUP BY 1")
def bin_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of seven extensions, by category of the bin and whether gzip may help."""
    name = F.concat(F.lit("f."), F.element_at(F.array(*(F.lit(x) for x in ("JPG", "mp4", "mp3", "apk", "zip", "docx", "txt"))), (F.col("o_orderkey") % 7 + 1).cast("int")))
    o = I.table(spark, sf_dir, "orders").select(name.alias("name"))
    return o.groupBy(M.bin_category(F.col("name")).alias("category")).agg(F.count("*").alias("items"), F.count_if(M.worth_compressing(F.col("name"))).alias("worth"))


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as videos: size from the price (up to gigabytes), dated by the order, every third named by a phone with that date, every seventh with a sane container date a year before."""
    o = I.table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("VID_"), F.date_format(at, "yyyyMMdd"), F.lit("_101112.mp4"))).otherwise(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit(".mp4")))
    return o.select(
        F.col("o_orderkey").alias("id"), name.alias("name"), F.concat(F.lit("/m/"), name).alias("path"), (F.round(F.col("o_totalprice") * 100).cast("long") * 97).alias("size_bytes"), (at + F.expr("INTERVAL 40 DAYS")).alias("modified"),
        F.when(F.col("o_orderkey") % 7 == 0, at - F.expr("INTERVAL 365 DAYS")).alias("created"), F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(30.0).alias("fps"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(20.0)).alias("seconds"), F.lit(None).cast("string").alias("codec"), F.when(F.col("o_orderkey") % 50 == 0, "V02").alias("health"),
    )


_V = f"""v AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) * 97 AS n, o_orderdate + INTERVAL 40 DAY AS m, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate - INTERVAL 365 DAY END AS c,
  CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('day', o_orderdate) + INTERVAL '36672 seconds' END AS nm, o_orderkey % 2 = 0 AS timed, o_orderkey % 50 = 0 AS bad FROM orders),
r AS (SELECT *, CASE WHEN c > TIMESTAMP '1995-01-01' AND c < {NOW} + INTERVAL 1 DAY THEN c WHEN nm > TIMESTAMP '1995-01-01' AND nm < {NOW} + INTERVAL 1 DAY THEN nm ELSE m END AS rec,
  CASE WHEN timed AND n >= 209715200 AND n * 8.0 / (1920 * 1080 * 30 * 20.0) >= 1.0 AND n - CAST(round(1920 * 1080 * 30 * 20.0 * 0.1 / 8) AS BIGINT) >= 0.5 * n THEN n - CAST(round(1920 * 1080 * 30 * 20.0 * 0.1 / 8) AS BIGINT) END AS saving FROM v),
a AS (SELECT *, epoch_us({NOW}) - epoch_us(rec) AS age FROM r),
j AS (SELECT *, CASE WHEN bad THEN 'V02' WHEN age >= 365 * 86400000000 AND n >= 524288000 THEN 'V10' WHEN n >= 2147483648 THEN 'V11' WHEN saving IS NOT NULL THEN 'V12' WHEN n >= 524288000 THEN 'V13' WHEN age >= 365 * 86400000000 AND n >= 104857600 THEN 'V14' END AS would FROM a),
h AS (SELECT *, CASE WHEN would >= 'V10' AND age < 14 * 86400000000 THEN NULL ELSE would END AS rule FROM j)"""


@query(f"WITH {_V} SELECT id, rule, would IS NOT NULL AND rule IS NULL AS recent FROM h")
def video_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and age rules of videos with the recorded date from container, name or file."""
    return videos.judge(_videos(spark, sf_dir), F.expr(NOW)).select("id", "rule", F.coalesce(F.col("held") == "recent", F.lit(False)).alias("recent"))


@query(f"""WITH {_V}, b AS (SELECT *, CASE rule WHEN 'V02' THEN 'unplayable' WHEN 'V10' THEN 'oldLarge' WHEN 'V11' THEN 'huge' WHEN 'V12' THEN 'oversized' WHEN 'V13' THEN 'large' WHEN 'V14' THEN 'old' END AS batch FROM h WHERE rule IS NOT NULL)
SELECT batch, count(*) AS items, CAST(sum(n) AS BIGINT) AS bytes, CASE WHEN batch = 'oversized' THEN CAST(sum(saving) AS BIGINT) ELSE 0 END AS saving_bytes, batch = 'unplayable' AS preselect FROM b GROUP BY batch""")
def video_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos.batches(videos.judge(_videos(spark, sf_dir), F.expr(NOW))).drop("sources").fillna(0, ["saving_bytes"])


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Android' WHEN 1 THEN 'GNOME' WHEN 2 THEN 'Windows' END AS tool, CASE WHEN event_id % 4 = 0 THEN event_type END AS app, CASE WHEN event_id % 4 < 2 THEN epoch_us(ts) // 1000000 ELSE 0 END AS taken_s FROM events")
def screenshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as screenshots named by three tools, or by none."""
    e, at = I.table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    name = F.when(k == 0, F.concat(F.lit("Screenshot_"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("_"), "event_type", F.lit(".png"))).when(k == 1, F.concat(F.lit("Screenshot from "), F.date_format(at, "yyyy-MM-dd HH-mm-ss"), F.lit(".png")))
    name = name.when(k == 2, F.concat(F.lit("Screenshot ("), F.col("event_id").cast("string"), F.lit(").png"))).otherwise("holiday.png")
    m = M.match_name(F.col("name"), F.lit("/a/x"), M.SCREENSHOTS)
    return e.select("event_id", name.alias("name")).select(F.col("event_id").alias("id"), m.alias("m")).select("id", "m.tool", "m.app", F.coalesce(F.unix_seconds(M.taken_at(F.col("m"))), F.lit(0)).alias("taken_s"))


@query(f"""WITH s AS (SELECT event_id, event_type AS kind, user_id % 3 AS u, ts, event_id % 10 AS h FROM events),
b AS (SELECT CASE WHEN h = 0 THEN 'empty' WHEN h = 1 THEN 'unreadable' ELSE kind END AS batch, epoch_us({NOW}) - epoch_us(ts) >= 30 * 86400000000 AS old FROM s) SELECT batch, count(*) AS items, count(*) FILTER (WHERE old) AS old FROM b GROUP BY 1""")
def screenshot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 10 == 0, "E01").when(F.col("event_id") % 10 == 1, "U07").alias("health"), (F.col("user_id") % 3).cast("string").alias("app"), F.col("ts").cast("timestamp").alias("taken"))
    return reports.screenshot_batches(rows, F.expr(NOW)).drop("apps")


@query("""SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'E01' WHEN page_id % 5 = 1 THEN 'E03' WHEN page_id % 5 = 2 THEN 'U03' END AS rule FROM pages""")
def pages_empty_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML files: some emptied, some with markup alone, some unfinished downloads; the others are whole."""
    p, k = I.table(spark, sf_dir, "pages"), F.col("page_id") % 5
    content = F.when(k == 0, "").when(k == 1, F.lit("<html><head><title>t</title></head><body> <br> </body></html>")).otherwise(F.col("html")).cast("binary")
    p = p.select(F.col("page_id").alias("id"), F.when(k == 2, "p.html.crdownload").otherwise("p.html").alias("name"), content.alias("whole"))
    p = p.select("id", "name", F.octet_length("whole").cast("long").alias("size_bytes"), F.substring("whole", 1, 4096).alias("head"), F.expr("right(whole, 65557)").cast("binary").alias("tail"), "whole", F.lit(None).cast("string").alias("issue"))
    return health.health(p).select("id", "rule")


@query("""WITH a AS (SELECT vec_id AS id, label AS h, vec_id % 3 = 0 AS video, vec_id % 2 AS s FROM embeddings)
SELECT x.id, min(y.id) AS duplicate_of FROM a x JOIN a y ON x.h = y.h AND x.video = y.video AND x.s = y.s AND y.id < x.id GROUP BY 1""")
def library_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as photos and videos whose hash is their label: R4, the earliest of the same hash, kind and length."""
    v = I.table(spark, sf_dir, "embeddings")
    a = v.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), (F.col("vec_id") % 3 != 0).alias("is_image"), (F.col("vec_id") % 2).alias("seconds"), F.lit(False).alias("unreadable"), F.lit(99.0).alias("mean"), F.lit(50.0).alias("std"), F.lit(99.0).alias("sharpness"), F.col("label").cast("string").alias("hash"))
    return photos.library_verdicts(a).where("duplicate_of is not null").select("id", "duplicate_of")


@query("""WITH m AS (SELECT source AS g, doc_id AS id, (n_chars % 100) / 100.0 AS clarity, (doc_id % 10) / 10.0 AS centering, 100 + n_chars % 50 AS w FROM documents),
t AS (SELECT g, max(clarity) AS c, max(w * 100) AS p, count(*) AS members FROM m GROUP BY 1),
s AS (SELECT m.*, members, CASE WHEN c > 0 THEN 0.6 * clarity / c ELSE 0 END + 0.25 * centering + 0.15 * (w * 100) / p AS score FROM m JOIN t USING (g)),
u AS (SELECT g, max(score) AS top FROM s GROUP BY 1)
SELECT g AS "group", members, arg_min(id, (-w, id)) AS best_id FROM s JOIN u USING (g) WHERE score >= top - 0.02 AND members > 1 GROUP BY 1, 2""")
def best_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as photos in groups by source: the best copy by clarity, centring and resolution, near ties by size."""
    d = I.table(spark, sf_dir, "documents")
    m = d.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100.0).alias("clarity"), ((F.col("doc_id") % 10) / 10.0).alias("centering"), (100 + F.col("n_chars") % 50).alias("width"), F.lit(100).alias("height"), F.lit(None).cast("timestamp").alias("taken"))
    return photos.best_copies(m)


@query(f"""WITH u AS (SELECT o_custkey, max(o_orderdate) AS last_used FROM orders GROUP BY 1), a AS (SELECT c_custkey AS package, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS size_bytes, last_used, CASE WHEN c_custkey % 4 <> 0 THEN {NOW} - to_days((c_custkey % 200)::INT) END AS installed_at FROM customer LEFT JOIN u ON o_custkey = c_custkey WHERE c_nationkey <> 0 AND c_nationkey <> 1)
SELECT package, size_bytes FROM a WHERE (installed_at IS NULL OR installed_at <= {NOW} - INTERVAL 90 DAY) AND (last_used IS NULL OR last_used < {NOW} - INTERVAL 90 DAY) AND package % 11 <> 0""")
def unused_apps_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused apps with install dates; nation 1 is essential, every eleventh app is kept."""
    c = I.table(spark, sf_dir, "customer")
    usage = I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), F.col("o_orderdate").cast("timestamp").alias("last_used"))
    a = c.select(F.col("c_custkey").alias("package"), F.col("c_name").alias("label"), F.round(F.abs("c_acctbal") * 100).cast("long").alias("size_bytes"), F.when(F.col("c_custkey") % 4 != 0, F.expr(NOW).cast("timestamp") - F.make_dt_interval((F.col("c_custkey") % 200).cast("int"))).alias("installed_at"), (F.col("c_nationkey") == 0).alias("is_system"))
    apps = listing.installed_apps(a, usage, c.where("c_nationkey = 1").select(F.col("c_custkey").alias("package")))
    return listing.unused_apps(apps, F.expr(NOW), kept=c.where("c_custkey % 11 = 0").select(F.col("c_custkey").alias("package"))).select("package", "size_bytes")


@query("""WITH f AS (SELECT doc_id AS id, sha256(text) AS g FROM documents), e AS (SELECT doc_id AS id, source || sha256(text) AS g FROM documents),
p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM f GROUP BY g)) AS found, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM e GROUP BY g)) AS expected)
SELECT CAST(found AS BIGINT) AS found, CAST(expected AS BIGINT) AS expected, CAST(expected AS BIGINT) AS "right", expected / found AS "precision", 1.0::DOUBLE AS recall FROM p""")
def grouping_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall in pairs of groups by content against groups by content and source."""
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.sha2("text", 256).alias("key"))
    return reports.precision_recall(d.select("id", F.col("key").alias("group")), d.select("id", F.concat("source", "key").alias("group")))


@query("""SELECT doc_id AS id, sha256(regexp_replace(regexp_replace(regexp_replace(text, chr(13) || chr(10) || '?', chr(10), 'g'), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '\\s+$', '')) AS key FROM documents""")
def docs_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of normalised texts: line ends made one, white space at ends of lines and of the text dropped."""
    return I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(T.normalized(F.col("text")), 256).alias("key"))
