"""Changes of state, reports, listings, text functions and the document scan against small references."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from siltsieve.functions import text as T
from siltsieve.operators import clusters, documents, graph, matching, reports, state
from siltsieve.sources import listing
from siltsieve.streaming import alerts

NOW = dt.datetime(2026, 10, 7, 12)
EX = "kind string, id string, excluded_at timestamp, until timestamp, label string"


def test_bin_and_exclusions(spark):
    bin_ = spark.createDataFrame([("a", "duplicate", NOW), ("b", "blurry", NOW - dt.timedelta(days=30))], "id string, reason string, collected_at timestamp")
    ex = spark.createDataFrame([("file", "c", NOW, NOW + dt.timedelta(days=1), "Zed"), ("file", "d", NOW, None, None), ("app", "c", NOW, NOW, "x")], EX)
    b2, e2 = state.collect(bin_, ex, spark.createDataFrame([("a", "x"), ("c", None)], "id string, reason string"), F.lit(NOW))
    assert {(r.id, r.reason) for r in b2.collect()} == {("a", "duplicate"), ("b", "blurry"), ("c", "manual")} and {(r.kind, r.id) for r in e2.collect()} == {("file", "d"), ("app", "c")}
    b3, e3 = state.recover(b2, e2, spark.createDataFrame([("a", "A")], "id string, label string"), F.lit(NOW), do_not_collect=True)
    assert {r.id for r in b3.collect()} == {"b", "c"} and {(r.id, r.until) for r in e3.where("kind = 'file'").collect()} == {("a", NOW + dt.timedelta(days=30)), ("d", None)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    b4, gone = state.delete(bin_, ids("a", "b", "zz"), ids("a", "zz"), ids("b"))
    assert b4.count() == 0 and {r.id for r in gone.collect()} == {"a", "b"}
    assert [r.id for r in state.active(ex, F.lit(NOW)).collect()] == ["c", "d"]
    assert state.restore(state.remove(ex, ex.where("id = 'd'")), ex.where("id = 'd'")).count() == 3 and state.purge(ex, F.lit(NOW)).count() == 2
    assert [r.id for r in state.expired(bin_, F.lit(NOW)).collect()] == ["b"]
    lines = state.to_json_lines(ex)
    assert sorted(map(str, state.parse_exclusions(lines).select("kind", "id", "until").collect())) == sorted(map(str, ex.select("kind", "id", "until").collect()))


def test_lines_of_records(spark):
    rows = spark.createDataFrame([("a|b|duplicate|1000",), ("x|strange|0",), ("bad",), ("|duplicate|1",), ("y|duplicate|zz",)], "line string")
    assert {(r.id, r.reason) for r in state.parse_records(rows).collect()} == {("a|b", "duplicate"), ("x", "other")}
    old = spark.createDataFrame([("p/q|86400000",), ("{broken",), ('{"id": "k", "excludedAt": 5}',)], "line string")
    assert {(r.id, r.kind, r.until is None) for r in state.parse_exclusions(old).collect()} == {("p/q", "file", False), ("k", "file", True)}


def test_admission_in_order(spark):
    sizes = [60, 50, 30, 20, 10, 5]
    df = spark.createDataFrame([(k, f"f{k}", n) for k, n in enumerate(sizes)], "seq int, id string, stored_bytes long").repartition(3)
    assert [r.admitted for r in state.admit(df, used=0, cap=100).orderBy("seq").collect()] == [True, False, True, False, True, False]
    assert state.admit(df.limit(0)).count() == 0


def test_free_names(spark):
    names = spark.createDataFrame([(1, "/f", "a.txt"), (2, "/f", "b.txt"), (3, "/g", "a.txt"), (4, "/f", "c")], "id int, folder string, name string")
    taken = spark.createDataFrame([("/f", "a.txt"), ("/f", "a (1).txt"), ("/f", "a (3).txt"), ("/f", "c")], "folder string, name string")
    assert {r.id: r.free for r in state.free_name(names, taken).collect()} == {1: "a (2).txt", 2: "b.txt", 3: "a.txt", 4: "c (1)"}


def test_reports(spark, tmp_path):
    rows = [("emptyFile", "f1", "a", 10, False, "0 bytes"), ("duplicatePhoto", "g1", "a", 10, False, "two copies"), ("duplicatePhoto", "g1", "b", 10, True, "two copies"), ("duplicatePhoto", "g2", "c", 5000, False, "three"), ("duplicatePhoto", "g2", "d", 5000, True, "three")]
    f = spark.createDataFrame(rows, "category string, finding string, id string, size_bytes long, is_kept boolean, reason string")
    items = spark.createDataFrame([("a", "/x/a", 10), ("b", "/x/b", 10), ("c", "/y/c", 5000), ("e", None, 1)], "id string, path string, size_bytes long")
    assert tuple(reports.totals(items).first()) == (4, 5021, 2) and tuple(reports.overall(f).first()) == (2, 5010)
    assert [tuple(r) for r in reports.by_category(f).collect()] == [("emptyFile", 1, 10), ("unreadableFile", 0, 0), ("duplicatePhoto", 2, 5010), ("blankPhoto", 0, 0), ("unusedApp", 0, 0)]
    out = json.loads(reports.to_json(f, items).first().report)
    assert out["reclaimableBytes"] == 5010 and out["categories"]["duplicatePhoto"]["findings"] == 2
    lines = [r.line for r in reports.text(f, items, most=1).collect()]
    assert lines[0] == "Scanned 4 items (4.9 KB)" and "  … and 1 more" in lines and any("three (4.9 KB)" in x for x in lines)
    got = [json.loads(r.line) for r in reports.findings_json(f).collect()]
    assert {(g["finding"], len(g["items"])) for g in got} == {("f1", 1), ("g1", 2), ("g2", 2)}
    reports.write_report(spark, f, items, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r" / "text")).count() == len([r for r in reports.text(f, items).collect()])
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    want = {999: "999 B", 1500: "1.5 KB", 2000: "2 KB", 123_000_000: "123 MB", 999_499: "999 KB", 999_500: "1 MB", 1_200_000_000: "1.2 GB"}
    assert {n: one(reports.decimal_bytes(F.lit(n).cast("long"))) for n in want} == want
    group = lambda *g: spark.createDataFrame([(i, k) for k, v in enumerate(g) for i in v], "id int, group int")
    q = reports.precision_recall(group((1, 2, 3), (4, 5)), group((1, 2), (3, 4, 5))).first()
    assert (q.found, q.expected, q.right, q.precision, q.recall) == (4, 4, 2, 0.5, 0.5)
    assert {tuple(r) for r in reports.matching_groups(group((1, 2, 3), (4, 5)), group((1, 2), (9,))).collect()} == {(0, 0, 2), (1, None, None)}


def test_decimal_bytes_round_as_printf(spark):
    sizes = [0, 999, 1000, 1150, 1250, 1350, 99950, 100500, 101500, 999499, 999500, 2250000, 2750000, 1150000000, 100500000, 999499999999, 2050000000000]
    got = {r.n: r.x for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", reports.decimal_bytes(F.col("n")).alias("x")).collect()}
    for n in sizes:
        u = sum(n >= low for low in (1000, 999500, 999500000, 999500000000))
        x = n / 1000**u
        assert got[n] == (f"{x:.0f}" if x >= 100 or not u else f"{x:.1f}".removesuffix(".0")) + " " + ["B", "KB", "MB", "GB", "TB"][u]


def test_listings(spark, tmp_path):
    one = listing.memory(spark, {"/a": b"1", "/b": b"22", "/c": b""}, frozenset({"/b"}))
    two = listing.memory(spark, {"/a": b"333"})
    got = {r.id: (r.size_bytes, r.source_id, r.issue is not None) for r in listing.composite(one, two).collect()}
    assert got == {"/a": (3, 1, False), "/b": (None, 0, True), "/c": (0, 0, False)}
    with pytest.raises(listing.PermissionMissing):
        listing.guarded(lambda: False, lambda: one)
    assert listing.guarded(lambda: True, lambda: one).count() == 3
    (tmp_path / "Android" / "data").mkdir(parents=True)
    (tmp_path / "Android" / "data" / "x").write_text("x")
    (tmp_path / "keep.txt").write_text("y")
    assert [r.name for r in listing.list_device(spark, listing.android(str(tmp_path))).collect()] == ["keep.txt"]
    (tmp_path / "apps.json").write_text(json.dumps([{"packageName": "a", "installedAt": 1000, "isSystem": False}, {"packageName": ""}, {"packageName": "b", "label": "B", "sizeBytes": 5, "lastUsedAt": "2026-01-01T00:00:00", "installedAt": -1}]))
    apps = listing.json_apps(spark, str(tmp_path / "apps.json"))
    assert {(r.package, r.label, r.size_bytes, r.installed_at is None, r.last_used is None) for r in apps.collect()} == {("a", "a", 0, False, True), ("b", "B", 5, True, False)}
    assert [r.package for r in listing.unused_apps(apps, F.lit(NOW), kept=apps.where("package = 'a'")).collect()] == ["b"]
    files = spark.createDataFrame([("/1", 3, bytearray(b"abc"), None, None, None), ("/2", 3, bytearray(b"abc"), None, None, None), ("/3", 0, bytearray(), None, None, None), ("/4", 9, bytearray(b"x"), 3.0, 2.0, 1.0), ("/5", 9, bytearray(b"y"), 99.0, 20.0, 1.0)], "path string, size_bytes long, content binary, mean double, std double, sharpness double")
    assert {r.path: (r.verdict, r.duplicate_of) for r in listing.classify_folder(files).collect()} == {"/1": (None, None), "/2": ("duplicate", "/1"), "/3": ("empty", None), "/4": ("black", None), "/5": ("blurry", None)}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.visible_text(F.lit("<p>&#65;b&#x1F600; &amp;#66; &#0; &#39;x&#39; &#xZZ;</p>"))) == "Ab😀 &#66; &#0; 'x' &#xZZ;"
    assert one(T.fnv32(F.lit("hello"))) == 0x4F9F2CAB and one(T.fnv32(F.lit(""))) == 2166136261
    assert one(T.normalized(F.lit("a \r\nb\t\rc  \n\n"))) == "a\nb\nc"
    r = random.Random(1)
    a = {r.getrandbits(60) for _ in range(200)}
    b = set(list(a)[:190]) | {r.getrandbits(60) for _ in range(10)}
    sign = lambda s: T.min_hashes(F.lit(sorted(s)))
    same = one(F.size(F.filter(F.zip_with(sign(a), sign(b), lambda x, y: x == y), lambda x: x)))
    assert abs(same / 64 - len(a & b) / len(a | b)) < 0.15
    assert one(F.size(F.array_intersect(T.band_keys(sign(a)), T.band_keys(sign(b))))) > 0
    code = chr(92) + "u33609? "
    assert one(T.rtf_text(F.lit(r"{\rtf1{\fonttbl{\f0 Arial;}}\f0\b Hello\b0  w\'f6rld\par " + code + "end}"))) == "Hello wörld " + chr(33609) + " end"


def test_document_scan_against_brute_force(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(900)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for k in range(60):
        w = list(base[k % 6])
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(120)] = f"x{r.randrange(900)}y" if r.random() < 0.5 else f"ref{r.randrange(10000, 99999)}"
        if k % 5 < 2:
            w[0] = f"ref{10_000 + k}"
        name = r.choice(["report.txt", "report final.txt", "report (1).txt", "invoice.txt"])
        sep = "  " if k % 7 == 0 else " "
        rows.append((k, name, f"/{r.choice(['docs', 'Download'])}/{name}", dt.datetime(2026, 1, 1) + dt.timedelta(days=r.randrange(50)) if k % 9 else None, sep.join(w)))
    df = spark.createDataFrame([(*x[:4], len(x[4].encode()), x[4]) for x in rows], "id long, name string, path string, modified timestamp, size_bytes long, content string").repartition(3)
    units = documents.units(df)
    stems = {n: {w for w in n.replace(".txt", "").replace("(", " ").replace(")", " ").split() if w not in T.VERSION_WORDS and not w.isdigit()} for n in {x[1] for x in rows}}
    by_text = {}
    for x in rows:
        by_text.setdefault(x[4], x)
    own = {x[0]: x for x in by_text.values()}
    first = {}
    for k in sorted(own):
        first.setdefault(tuple(own[k][4].split()), k)
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w, k in first.items()}
    num = {k: {t for t in w if sum(c.isdigit() for c in t) >= 4} for w, k in first.items()}
    want = {}
    for a in sets:
        for b in sets:
            s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and s >= 0.6:
                related = stems[own[a][1]] <= stems[own[b][1]] or stems[own[b][1]] <= stems[own[a][1]]
                differ = num[a] - num[b] and num[b] - num[a]
                want[a, b] = "similarity" if s < 0.85 else "names" if not related else "numbers" if differ else None
    got = {(x.a, x.b): x.blocked for x in documents.versions(units).collect()}
    assert got == want and {"similarity", "names", "numbers", None} <= set(want.values())
    members = documents.scan(df).collect()
    f04 = {p for p, why in want.items() if why is None}
    groups = {}
    for m in members:
        groups.setdefault(m.group, []).append(m)
    text = {x[0]: tuple(x[4].split()) for x in rows}
    for g in groups.values():
        keep = [m for m in g if m.kept]
        assert len(keep) == 1 and len(g) > 1
        for m in g:
            if not m.kept:
                p = tuple(sorted((first[text[m.id]], first[text[keep[0].id]])))
                assert m.rule == ("F01" if rows[m.id][4] == rows[keep[0].id][4] else "F03" if p[0] == p[1] else "F04") and (p[0] == p[1] or p in f04)
    edges = {(a, b): documents_strength for a, b in f04 for documents_strength in [1 + 1 + 0.5 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])]}
    seen, parts = set(), []
    for k in sorted(sets):
        if k not in seen:
            todo, part = [k], set()
            while todo:
                if (x := todo.pop()) not in part:
                    part.add(x)
                    todo += [b if a == x else a for a, b in f04 if x in (a, b)]
            seen |= part
            parts += clusters.complete_linkage(sorted(part), edges)
    whole = {frozenset(i for i in text if first[text[i]] in c) for c in map(set, parts)}
    assert {frozenset(m.id for m in g) for g in groups.values()} == {c for c in whole if len(c) > 1}
    listed = documents.group_list(documents.scan(df)).collect()
    assert [x.reclaimable_bytes for x in listed] == sorted((x.reclaimable_bytes for x in listed), reverse=True)
    assert documents.singles(df, documents.scan(df)).count() == len(rows) - len(members)


def linkage_by_definition(ids, edges):
    clusters = [[i] for i in sorted(ids)]
    while True:
        pairs = []
        for i, a in enumerate(clusters):
            for j in range(i + 1, len(clusters)):
                found = [edges.get((min(x, y), max(x, y))) for x in a for y in clusters[j]]
                if None not in found:
                    pairs.append((-min(found), i, j))
        if not pairs:
            return clusters
        _, i, j = min(pairs)
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] + clusters[j]]


def test_linkage_is_by_definition():
    r = random.Random(7)
    for n, share in [(2, 1.0), (12, 0.5), (25, 0.8), (25, 0.95), (40, 0.3)]:
        edges = {(a, b): r.choice([0.85, 0.9, 0.95]) for b in range(n) for a in range(b) if r.random() < share}
        assert clusters.complete_linkage(list(range(n)), edges) == linkage_by_definition(range(n), edges)


def test_linkage_goes_on_from_merged_clusters():
    for seed in range(60):
        r, n = random.Random(seed), 24
        edges = {(a, b): r.choice([0.85, 0.86, 0.9, 0.92, 0.95]) for b in range(n) for a in range(b) if r.random() < 0.85}
        parts, live = {((), k): [k] for k in range(n)}, {(((), a), ((), b)): s for (a, b), s in edges.items()}
        for _ in range(3):
            best = {}
            for (x, y), s in live.items():
                for e in (x, y):
                    best[e] = min(best.get(e, (9,)), (-s, min(x, y), max(x, y)))
            new, found = {}, {}
            for s, lo, hi in {k for k in best.values() if best[k[1]] == best[k[2]]}:
                new[lo] = new[hi] = ((s, *lo[0]), lo[1])
                parts[new[lo]] = parts.pop(lo) + parts.pop(hi)
            for (x, y), s in live.items():
                found.setdefault(tuple(sorted((new.get(x, x), new.get(y, y)))), []).append(s)
            two = set(new.values())
            live = {p: min(v) for p, v in found.items() if p[0] != p[1] and len(v) == (1 + (p[0] in two)) * (1 + (p[1] in two))}
        got = [sorted(i for k in c for i in parts[k]) for c in clusters._link(list(parts), live)]
        assert sorted(got) == sorted(map(sorted, linkage_by_definition(range(n), edges)))


def test_large_components_are_linked(spark):
    r = random.Random(8)
    chain = {(k, k + d): r.choice([0.86, 0.9, 0.95]) for k in range(230) for d in (1, 2) if k + d < 230}
    copies = {(1000 + a, 1000 + b): r.random() * 0.1 + 0.9 for b in range(210) for a in range(b)}
    found = {p: s for part in (chain, copies) for p, s in part.items()}
    units = spark.createDataFrame([(k,) for k in [*range(231), *range(1000, 1210)]], "unit long")
    df = spark.createDataFrame([(a, b, "F04", s) for (a, b), s in found.items()], "a long, b long, rule string, score double")
    got = {}
    for x in documents.groups(units, df).collect():
        got.setdefault(x.cluster, set()).add(x.unit)
    want = [set(c) for c in linkage_by_definition(range(230), chain)]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [*want, {230}, set(range(1000, 1210))]))
    assert all(min(c) == k for k, c in got.items()) and len(want) > 1


def test_components_are_linked_in_rounds(spark, monkeypatch):
    r = random.Random(9)
    parts = [[(at + a, at + b) for b in range(30) for a in range(b) if r.random() < 0.85] for at in range(0, 480, 40)]
    parts += [[(k, k + d) for k in range(500, 550) for d in (1, 2, 3)], [(a, b) for b in range(600, 612) for a in range(600, b) if a != 605]]
    edges = {p: r.choice([0.85, 0.875, 0.9, 0.95]) for part in parts for p in part}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()], "a long, b long, score double")
    want = sorted(sorted(c) for part in parts for c in linkage_by_definition({x for p in part for x in p}, edges))
    roots = graph.kept(graph.connected(df.select("a", "b")))
    for pairs, rounds in ((150, 60), (0, 3)):
        monkeypatch.setattr(clusters, "PAIRS", pairs)
        monkeypatch.setattr(clusters, "ROUNDS", rounds)
        got = {}
        for x in clusters.cluster_components(df, roots).collect():
            got.setdefault((x.root, x.cluster), []).append(x.id)
        assert sorted(map(sorted, got.values())) == want and all(min(c) == k[1] for k, c in got.items())


def test_hot_shingles_are_dealt_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    sets = [(k, sorted({1, 2, 3} | {r.randrange(40) for _ in range(6)})) for k in range(60)]
    df = spark.createDataFrame(sets, "unit long, s array<long>")
    every = {tuple(x) for x in documents.candidates(df).collect()}
    monkeypatch.setattr(documents, "BLOCK", 5)
    assert {tuple(x) for x in documents.candidates(df).collect()} == every
    near = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y))}
    assert near <= every


def test_common_passages_make_no_candidates(spark):
    r = random.Random(5)
    common = [r.getrandbits(60) for _ in range(40)]
    sets = {k: {r.getrandbits(60) for _ in range(60)} | set(common) for k in range(300)}
    sets |= {1000 + k: set(sorted(sets[k])[:95]) | {r.getrandbits(60)} for k in range(0, 300, 10)}
    df = spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "unit long, s array<long>").repartition(3)
    pairs = graph.kept(documents.candidates(df))
    assert pairs.count() < 10_000  # every two of the 300 that share the passage are 44,850
    want = {(a, b, len(x & y) / len(x | y)) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.6 * len(x | y)}
    assert len(want) == 30 and {tuple(x) for x in documents.scored(pairs, df).collect()} == want


def test_shingles_are_not_dealt_out(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, "a.txt", text if k < 5 else f"{k} " + text, k) for k in range(12)] + [(3, "a.txt", text, 3)]
    units = documents.units(spark.createDataFrame(rows, "id long, name string, content string, n long"))
    assert "Exchange hash" not in units._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.unit for r in units.collect()) == [0, *range(5, 12)]
    want = sorted(map(tuple, documents.versions(units).collect()), key=str)
    monkeypatch.setattr(documents, "DEALT", 0.01)
    monkeypatch.setattr(documents, "MOST_BROADCAST", 2)
    assert len(want) == 28 and sorted(map(tuple, documents.versions(units).collect()), key=str) == want


def test_hamming_is_exact(spark):
    r = random.Random(6)
    base = [r.getrandbits(63) for _ in range(40)]
    rows = [(k, base[k % 40] ^ sum(1 << i for i in r.sample(range(63), r.randrange(12)))) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, h long")
    for d in (0, 3, 8):
        want = {(a, b, (x ^ y).bit_count()) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= d}
        assert {tuple(p) for p in matching.hamming_pairs(df, "id", "h", d).collect()} == want


def test_components_raise_when_unsettled(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graph.connected(e, rounds=1)


def test_stream_equals_replay(spark, tmp_path):
    r = random.Random(3)
    rows = [(k % 3, k, k * 3600 * 1_000_000 * 7, r.choice(["ok", "low", "low", "critical"])) for k in range(60)]
    df = spark.createDataFrame(rows, "device long, seq long, t_us long, level string")
    want = {tuple(x) for x in alerts.replay(df).collect()}
    order = list(rows[:30])
    r.shuffle(order)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, part in enumerate((order, rows[30:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = alerts.alert_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select("device", "seq", "t_us", "level", "action").collect()} == want
