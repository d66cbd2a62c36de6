import datetime as dt

from pyspark.sql import functions as F

from siltsieve.functions import files, text
from siltsieve.operators import bins, clusters, graph, matching, rules
from siltsieve.sources.folder import FolderSource
from siltsieve.streaming.alerts import REPEAT_US, decide


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_extension_edges(spark):
    names = {".nomedia": "", "a.": "", "x.tar.GZ": "gz", "plain": "", "a.b": "b"}
    for name, want in names.items():
        assert one(spark, files.extension(F.lit(name))) == want


def test_media_kind(spark):
    assert one(spark, files.media_kind(F.lit("heic"))) == "image"
    assert one(spark, files.media_kind(F.lit("exe"))) == "other"


def test_shingles_edges(spark):
    w = lambda s: F.array(*[F.lit(x) for x in s.split()]) if s else F.array().cast("array<string>")
    assert one(spark, text.shingles(w(""))) == []
    assert one(spark, text.shingles(w("a b c d e"))) == ["a b c d e"]
    assert len(one(spark, text.shingles(w("a b c d e f")))) == 2
    assert one(spark, text.jaccard(w(""), w(""))) == 1.0


def test_name_stem(spark):
    a, b = text.name_stem(F.lit("Report final v2 (1).docx")), text.name_stem(F.lit("report.docx"))
    assert one(spark, a) == ["report"]
    assert one(spark, text.names_related(a, b))


def test_search_is_literal(spark):
    e = spark.createDataFrame([(1, "100%_a", "/x", "r", "c"), (2, "100xya", "/x", "r", "c")], "id int, file_name string, original_path string, reason string, category string")
    assert [r.id for r in bins.search(e, "%_").collect()] == [1]


def test_storage_level_boundaries(spark):
    gib = 1024**3
    at = lambda free, total: one(spark, files.storage_level(F.lit(float(free)), F.lit(float(total))))
    assert at(gib, 100 * gib) == "low"
    assert at(gib - 1, 100 * gib) == "critical"
    assert at(5 * gib, 100 * gib) == "ok"
    assert at(-1, 100) == "ok"


def test_alert_machine():
    action, held = decide("low", 0, ("ok", None))
    assert action == "notify"
    assert decide("low", REPEAT_US - 1, held)[0] == "none"
    assert decide("low", REPEAT_US, held)[0] == "notify"
    assert decide("low", -1, held)[0] == "notify"
    assert decide("critical", 1, held)[0] == "notify"
    action, better = decide("low", 2, ("critical", 1))
    assert (action, better) == ("none", ("low", 1))
    assert decide("ok", 3, better) == ("clear", ("ok", None))
    assert decide("ok", 3, ("ok", None))[0] == "none"


def test_rules_precedence_and_grace(spark):
    now = dt.datetime(2026, 1, 1, 12)
    df = spark.createDataFrame([("", now - dt.timedelta(minutes=5)), ("", now - dt.timedelta(minutes=10)), ("  ", now - dt.timedelta(days=1)), ("fine text", now), ("\u0001" * 80, now)], "content string, modified timestamp")
    found = rules.judge(df, rules.text_rules(F.col("content"), F.octet_length("content"), F.lit("txt")), modified=F.col("modified"), now=F.lit(now)).collect()
    assert [(r.rule, r.held_back) for r in found] == [(None, "E01"), ("E01", None), ("E02", None), (None, None), ("U09", None)]


def test_disabled_rule_policies(spark):
    df = spark.createDataFrame([("",)], "content string")
    two = [rules.Rule("A", "likely", F.lit(True)), rules.Rule("B", "certain", F.lit(True))]
    assert rules.judge(df, two, rules.Policy(disabled=frozenset("A"))).first().rule == "B"
    assert rules.judge(df, two, rules.Policy(disabled=frozenset("A"), on_disabled="stop")).first().rule is None
    assert rules.judge(df, two, rules.Policy(least="certain", on_unsure="stop")).first().rule is None


def test_chain_is_split():
    edges = {(1, 2): 0.9, (2, 3): 0.8}
    assert sorted(map(sorted, clusters.complete_linkage([1, 2, 3], edges))) == [[1, 2], [3]]
    assert clusters.first_fit([1, 2, 3], set(edges)) == [[1, 2], [3]]


def test_connected(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in graph.connected(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)}


def test_time_band_is_exact(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=m), 1) for i, m in enumerate((0, 10, 29, 30, 31, 90))]
    got = {(r.a, r.b) for r in matching.close_in_time(spark.createDataFrame(rows, "id long, t timestamp, g long"), "id", "t", "g", 30).collect()}
    want = {(a, b) for a, ta, _ in rows for b, tb, _ in rows if a < b and tb - ta <= dt.timedelta(minutes=30)}
    assert got == want


def test_folder_source_lists_empty_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "empty.zip").write_bytes(b"")
    (tmp_path / ".hidden").write_text("x")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.txt").write_text("b")
    spark.dataSource.register(FolderSource)
    found = {r.name: r.size_bytes for r in spark.read.format("folder").load(str(tmp_path)).collect()}
    assert found == {"a.txt": 5, "empty.zip": 0, "b.txt": 1}
