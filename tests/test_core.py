"""Graph, corpus, policy and streaming behaviour that the tables don't show."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st

from juralake.functions import ids
from juralake.operators import catalogue, corpus, diff, relations, resolve, service, temporal
from juralake.plans.context import QueryStamp, Sensitive, with_provenance
from juralake.sources import KeyValueTable, read_sparql_json
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_as_of_takes_older_version_that_has_the_file(spark):
    cons = spark.createDataFrame([("w", "a", "2018-01-01"), ("w", "b", "2023-06-01"), ("w", "c", "2024-01-01"), ("z", "d", "2024-01-01")], "work string, cons string, date string").withColumn("date", F.col("date").cast("date"))
    ex = spark.createDataFrame([("a", "xa", "de"), ("b", "xb", "de"), ("c", "xc", "de"), ("d", "xd", "de")], "cons string, expr string, lang string")
    ma = spark.createDataFrame([("xa", "h/xml/1"), ("xb", "h/pdf/1"), ("xc", "h/xml/3"), ("xd", "h/xml/4")], "expr string, url string")
    got = rows(temporal.consolidation_at(cons, ex, ma, "2023-06-15"))
    assert [(g[0], g[1]) for g in got] == [("w", "a")]
    assert rows(resolve.manifestation_at(cons, ex, ma, "2023-06-15", fmt="pdf"))[0][1] == "b"


@pytest.mark.parametrize("status,entry,end,as_of,want", [("s/0", "2000-01-01", "2010-01-01", "2020-01-01", False), ("s/0", None, None, "2020-01-01", True), ("s/3", None, None, "2020-01-01", False), ("s/3", "2000-01-01", "2010-01-01", "2010-01-01", False), ("s/3", "2000-01-01", "2010-01-01", "2009-12-31", True)])
def test_in_force(spark, status, entry, end, as_of, want):
    w = spark.createDataFrame([("w", status, entry, end)], "work string, status string, e string, n string").select("work", "status", F.col("e").cast("date").alias("date_entry"), F.col("n").cast("date").alias("date_no_longer"), F.lit(None).cast("date").alias("date_end"))
    keys = spark.createDataFrame([("w",), ("unknown",)], "work string")
    assert [r[1] for r in rows(temporal.in_force(keys, w, as_of), "work")] == [False, want]


def test_prefix_trap_and_cycle(spark):
    w = spark.createDataFrame([("eli/cc/76",)], "work string")
    i = spark.createDataFrame([("i1", "s", "eli/cc/76/art_1"), ("i2", "s", "eli/cc/762/art_1"), ("i3", "s", "eli/cc/77")], "impact string, source string, target string").withColumns({c: F.lit(None).cast("string") for c in ("type", "date", "comment")})
    assert len(rows(relations.impacts_on(w, i))) == 2 and len(rows(relations.impacts_on(w, i, strict=True))) == 1
    p = spark.createDataFrame([("b", "a", "t"), ("c", "b", "t"), ("a", "c", "t")], "child string, parent string, type string")
    assert len(rows(relations.subdivisions(p))) == 9
    c = spark.createDataFrame([("eli/cc/76", "x", "d2"), ("eli/cc/76", "x", "d1"), ("eli/cc/76", "x", None)], "source string, target string, description string")
    assert rows(relations.citations_of(w, c)) == [("eli/cc/76", "eli/cc/76", "x", "d1")] or rows(relations.citations_of(w, c))[0][1:] == ("eli/cc/76", "x", "d1")


def test_numbers_titles_vocabulary(spark):
    w = spark.createDataFrame([("a", "1.1", "s/0"), ("b", "1.1", "s/3")], "work string, legal_id string, status string")
    t = spark.createDataFrame([("a", "de", 'Say "x" %_')], "work string, lang string, title string")
    assert len(rows(resolve.resolve_number(w, t, "1.1"))) == 2
    assert rows(resolve.search_titles(w, t, "%_")) and not rows(resolve.search_titles(w, t, '"q"'))
    c = spark.createDataFrame([("v/1",), ("v/2",)], "concept string")
    lab = spark.createDataFrame([("v/1", "de", "eins")], "concept string, lang string, label string")
    assert rows(catalogue.list_vocabulary(c, lab, "v"), "concept") == [("v/1", "eins"), ("v/2", None)]


def test_corpus(spark, tmp_path):
    v = [("e", "v1", dt.date(2000, 1, 1), dt.datetime(2020, 1, 1), "old\ttab\nline \\n \\x"), ("e", "v2", dt.date(2015, 1, 1), dt.datetime(2020, 1, 1), "new"), ("e", "v2", dt.date(2015, 1, 1), dt.datetime(2021, 1, 1), "corrected")]
    d = spark.createDataFrame(v, corpus.SCHEMA)
    assert rows(corpus.resolve_as_of(d, "2010-01-01"))[0][4].startswith("old") and rows(corpus.resolve_as_of(d, "2016-01-01"))[0][4] == "corrected"
    assert rows(corpus.resolve_as_of(d, "2016-01-01", known_at="2020-06-01"))[0][4] == "new" and not rows(corpus.resolve_as_of(d, "1999-01-01"))
    corpus.dump_snapshot(d, str(tmp_path / "s"))
    assert sorted(rows(corpus.restore_snapshot(spark, str(tmp_path / "s")))) == sorted(map(tuple, v))
    for bad in ("#corpus-snapshot v9\n", "#corpus-snapshot v1\na\tb\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(Exception, match="snapshot"):
            corpus.restore_snapshot(spark, str(tmp_path / "bad.txt")).collect()


def test_diff_orientation(spark):
    a, b = (spark.createDataFrame(x, "work string, eid string, text string") for x in ([("w", "1", "x"), ("w", "2", "y")], [("w", "2", "z"), ("w", "3", "n")]))
    assert [r[1:4] for r in rows(diff.compare_versions(a, b))] == [(["1"], ["2"], ["3"])]
    assert [r[1:4] for r in rows(diff.diff_to_markdown(a, b))] == [(["3"], ["2"], ["1"])]


def test_bucket_and_breaker(spark):
    r = spark.createDataFrame([("k", i, 0, 1) for i in range(200)], "key string, request_id long, ts_ms long, cost int")
    assert service.token_bucket(r, 100, 0.0).where("allowed").count() == 100
    ok, left, retry, at = service.acquire(0.0, 0, 500, 3, 10, 10.0)
    assert (ok, left, retry) == (True, 2.0, 0) and service.acquire(0.0, 0, 0, 1, 10, 0.0)[2] == -1
    b = service.Breaker(2, 100)
    assert [b.call(t, f)[0] for t, f in ((0, True), (1, True), (50, False), (101, True), (150, False), (202, False), (203, True))] == ["closed", "closed", "open", "half-open", "open", "half-open", "closed"]


def test_streaming_bucket_matches_batch(spark, tmp_path):
    from juralake.streaming import token_bucket_stream

    schema = "key string, request_id long, ts_ms long, cost int"
    d = spark.createDataFrame([(f"k{i % 3}", i, i * 100, 1 + i % 4) for i in range(60)], schema)
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = token_bucket_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 5, 2.0).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("bucket"), "request_id") == rows(service.token_bucket(d, 5, 2.0), "request_id")


def test_registry_never_raises():
    reg = service.Registry()
    reg.register(service.Tool("boom", "Discovery", lambda: 1 / 0, "Navigator"))
    assert "error" in reg.dispatch("none", "Reader") and "error" in reg.dispatch("boom", "Reader") and "error" in reg.dispatch("boom", "Validator")
    assert next(iter(reg)).cost == 5


def test_context(spark):
    s = QueryStamp.make("2020-01-02", tx=dt.datetime(2024, 1, 1))
    p = with_provenance(spark.createDataFrame([("e",)], "eli string"), "eli", s, F.lit(None)).first()["provenance"]
    assert (p["eli"], p["valid_as_of"], p["kind"]) == ("e", dt.date(2020, 1, 2), "norm")
    assert "x" not in repr(Sensitive("x")) + str(Sensitive("x")) and Sensitive("x").reveal() == "x"
    with pytest.raises(ValueError):
        QueryStamp.make("2020-1-2")


def test_stores(spark, tmp_path):
    kv = KeyValueTable(spark, str(tmp_path / "kv"), "t1", "s")
    kv.put(a="1", b="2")
    kv.put(a="3")
    kv.delete("b")
    assert kv.get("a") == "3" and kv.get("b") is None
    KeyValueTable(spark, str(tmp_path / "kv"), "t2", "s").put(a="9")
    assert kv.get("a") == "3"
    doc = '{"head":{"vars":["x"]},"results":{"bindings":[{"x":{"type":"literal","value":"v","xml:lang":"de"}},{}]}}'
    got = read_sparql_json(spark.createDataFrame([(doc,)], "json string"), ["x"]).collect()
    assert got[0]["x"]["lang"] == "de" and got[1]["x"] is None


@given(st.text(alphabet="ab:*?[] ", max_size=6))
def test_key_parts(part):
    good = part.strip() != "" and not set(part) & set(":*?[]")
    try:
        KeyValueTable._check(part)
        assert good
    except ValueError:
        assert not good


def test_id_functions(spark):
    d = spark.createDataFrame([("art_14_a",), ("lbl_a/x_b",), ("art_2_b/para_1",), ("art_1_A",), ("x_a\n",)], "e string")
    assert [r[0] for r in rows(d.select(ids.normalize_eid(F.col("e"))))] == ["art_14a", "lbla/xb", "art_2b/para_1", "art_1_A", "x_a\n"]


def impacts(spark, rows):
    return spark.createDataFrame(rows, "impact string, source string, target string").withColumns({c: F.lit(None).cast("string") for c in ("type", "date", "comment")})


def test_ids_of_any_depth(spark):
    """Works of three to seven steps in one table, with and without a host, and one that ends in a slash."""
    h = "https://h.org/"
    works = ["eli/cc/76", "eli/cc/2017/762", h + "eli/cc/2017/762", "eli/cc/2017/762/x/y", "eli/cc/a/b/c/d/e", "eli/oc/", ""]
    targets = ["eli/cc/76", "eli/cc/762/art_1", "eli/cc/2017/762/art_1", "eli/cc/2017/7621", h + "eli/cc/2017/762/art_2/para_1", "eli/cc/2017/762/x/y/art_3", "eli/cc/a/b/c/d/e", "eli/oc/1", "eli/cc", None]
    w = spark.createDataFrame([(x,) for x in works], "work string")
    i = impacts(spark, [(str(k), "s", t) for k, t in enumerate(targets)])
    want = lambda ok: sorted((x, t) for x in works if x for t in targets if t and ok(x, t))
    assert sorted((r["work"], r["target"]) for r in relations.impacts_on(w, i).collect()) == want(lambda x, t: t.startswith(x))
    assert sorted((r["work"], r["target"]) for r in relations.impacts_on(w, i, strict=True).collect()) == want(lambda x, t: t == x or t.startswith(x + "/"))
    q = w.withColumn("eid", F.lit("art_3"))
    assert [(r["work"], r["target"]) for r in relations.article_history(q, i).orderBy("work").collect()] == [("eli/cc/2017/762", "eli/cc/2017/762/x/y/art_3"), ("eli/cc/2017/762/x/y", "eli/cc/2017/762/x/y/art_3")]
    assert relations.impacts_on(w.where("false"), i).count() == 0 == relations.impacts_on(w, i.where("false")).count()


def test_closure_has_no_depth_limit(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}", "t") for i in range(30)], "child string, parent string, type string")
    assert relations.subdivisions(chain).count() == 30 * 31 // 2
    assert sorted(r["sub"] for r in relations.subdivisions(chain, roots=spark.createDataFrame([("n27",)], "work string")).collect()) == ["n28", "n29", "n30"]
    assert relations.subdivisions(chain.where("false")).count() == 0


def test_every_request_gets_a_decision(spark):
    r = spark.createDataFrame([("k", 1, 0, 1, "Reader"), ("k", 2, 1, 1, "Admin"), ("k", 3, 2, 1, None), ("k", 4, 3, 200, "Validator"), ("k", 5, 60_003, 60, "Reader"), (None, 6, 0, 1, "Reader"), ("m", 7, None, 1, "Reader")], "key string, request_id long, ts_ms long, cost int, role string")
    got = {x["request_id"]: (x["allowed"], x["tokens"], x["retry_ms"]) for x in service.quota_decisions(r).collect()}
    # the refused don't touch the bucket; 59 and a little are too few for 200; after a minute unused it is full again
    assert got == {1: (True, 59.0, 0), 2: (False, 59.0, -1), 3: (False, 59.0, -1), 4: (False, 59.012, 35247), 5: (True, 0.0, 0), 6: (True, 59.0, 0), 7: (False, 0.0, -1)}
    assert service.quota_decisions(r, store_up=False).where("degraded").count() == 7


def test_visible_tools_of_unknown_roles(spark):
    u = spark.createDataFrame([("a", "Navigator"), ("b", "Admin"), ("c", None)], "user string, role string")
    t = spark.createDataFrame([("read", "Reader"), ("check", "Validator"), ("odd", "Admin")], "tool string, min_role string")
    assert [(r["user"], r["tool"]) for r in service.visible_tools(u, t).collect()] == [("a", "read")]


def test_snapshot_header_and_escapes(spark, tmp_path):
    v = [("#corpus-snapshot v1", "v", dt.date(2000, 1, 1), dt.datetime(2020, 1, 1), "a\x00b\\\\t\\ c"), ("e", "v", dt.date(2000, 1, 1), dt.datetime(2020, 1, 1), "")]
    corpus.dump_snapshot(spark.createDataFrame(v, corpus.SCHEMA), str(tmp_path / "s"))
    assert sorted(rows(corpus.restore_snapshot(spark, str(tmp_path / "s")))) == sorted(map(tuple, v))
    (tmp_path / "bare.txt").write_text("e\tv\t2000-01-01\t2020-01-01T00:00:00.000000Z\tx\n")
    with pytest.raises(Exception, match="header"):
        corpus.restore_snapshot(spark, str(tmp_path / "bare.txt")).collect()


def test_pages_without_a_key(spark):
    d = spark.range(45).select((F.col("id") % 7).alias("g"), "id").repartition(4)
    want = [r["id"] for r in d.orderBy("g", F.desc("id")).collect()]
    for page in range(6):
        got = diff.paginate(d, page, 10, "g", F.desc("id")).collect()
        assert sorted(r["id"] for r in got) == sorted(want[page * 10 : page * 10 + 10]) and {r["has_more"] for r in got} <= {page < 4}


def test_top_k_both_ways(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = [rng.normal(size=4).round(1).tolist() for _ in range(60)] + [[0.0] * 4, None, [1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0]]
    q = spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(v)], "query_id string, vector array<double>")
    items = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(None, v[0])], "item_id long, vector array<double>")
    want = []
    for i, x in enumerate(v):
        if x is None or not any(x):
            continue
        s = sorted((-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 9), k) for k, y in enumerate(v) if y is not None and any(y) and len(y) == len(x))
        want += [(f"q{i}", k, n + 1) for n, (_, k) in enumerate(s[:3])]
    for params in ({}, {"block": 7}, {"query_bytes": 500, "block": 1}):
        assert sorted((r["query_id"], r["item_id"], r["rank"]) for r in service.top_k_similar(q, items, 3, **params).collect()) == sorted(want)


def test_streaming_breaker_matches_batch(spark, tmp_path):
    from juralake.streaming import breaker_stream

    schema = "key string, call_id long, ts_ms long, failed boolean"
    d = spark.createDataFrame([(f"k{i % 3}", i, i * 100, i % 5 < 3) for i in range(90)], schema)
    for k in range(3):  # three files are three batches
        d.where(f"call_id >= {30 * k} and call_id < {30 * k + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = breaker_stream(stream, 2, 500).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("breaker"), "call_id") == rows(service.circuit_breaker(d, 2, 500), "call_id")


def test_all_tools(spark):
    from juralake.operators.tools import NAMES, surface
    from juralake.plans.queries import Tables

    reg = surface(Tables(spark, "/root/testdata/sf0.001"))
    assert sorted(t.name for t in reg) == sorted(n for names in NAMES.values() for n in names) and len(list(reg)) == 25
    assert {t.name for t in reg.for_role("Reader")} == set(NAMES["LocalNavigation"]) and len(reg.for_role("Validator")) == 25 and not reg.for_role("Admin")
    words = {"doc_id": "1", "other": "2", "eid": "art_1", "query": "a", "work": "eli/cc/1", "number": "1.1", "as_of": "1998-06-30"}
    for tool in reg:
        got = reg.dispatch(tool.name, "Validator", **{k: words[k] for k in tool.schema["required"]})
        assert "data" in got and got["data"].columns, (tool.name, got)
    assert reg.dispatch("read_article", "Reader", doc_id="1", eid="art_1")["data"].count() == 1
    assert "not allowed" in reg.dispatch("search_law", "Reader", query="x")["error"] and "missing" in reg.dispatch("search_law", "Navigator")["error"]
    assert "unknown" in reg.dispatch("search_law", "Navigator", query="x", as_of="2020-01-01")["error"]


def test_sparql_source(spark):
    import json
    import re
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from juralake.sources.sparql import register

    class Endpoint(BaseHTTPRequestHandler):
        def do_POST(self):
            q = self.rfile.read(int(self.headers["Content-Length"])).decode()
            m = re.search(r"LIMIT (\d+) OFFSET (\d+)", q)
            lo, n = (int(m[2]), int(m[1])) if m else (0, 100)
            all_ = [{"x": {"type": "uri", "value": f"v{i}"}} | ({"t": {"type": "literal", "value": "w", "xml:lang": "de"}} if i % 2 else {}) for i in range(5)]
            body = json.dumps({"head": {"vars": ["x", "t"]}, "results": {"bindings": all_[lo : lo + n]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    read = lambda **o: spark.read.format("sparql").options(endpoint=f"http://127.0.0.1:{server.server_port}/", variables="?x, t", **o).load()
    for got in (read(query="SELECT"), read(query="SELECT ORDER BY ?x", page_size="2", pages="3")):
        got = sorted(got.collect(), key=lambda r: r["x"]["value"])
        assert [r["x"]["value"] for r in got] == [f"v{i}" for i in range(5)] and got[0]["t"] is None and got[1]["t"]["lang"] == "de"
    server.shutdown()


def test_shared_tables_build_once(spark, tmp_path):
    from juralake.plans.shared import SharedTables, source_state

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    s, built = SharedTables(), []

    def build():
        built.append(1)
        if len(built) == 1:
            raise ValueError("once")
        return spark.read.parquet(path)

    with pytest.raises(ValueError):
        s.get(spark, "n", source_state(spark, path), build)
    s.warm(spark, {"n": (source_state(spark, path), build)})
    assert s.get(spark, "n", source_state(spark, path), build).count() == 3 and len(built) == 2
    spark.range(4).write.mode("append").parquet(path)
    assert s.get(spark, "n", source_state(spark, path), build).count() == 7 and len(built) == 3


def test_topic_classes_hold_every_link(spark):
    """Hundreds of works under one parent and some under several: all links, counted and by class, with no cap."""
    wt = spark.createDataFrame([(f"w{i}", f"t{i % 4}") for i in range(60)] + [("w0", "t1"), ("w1", "t9"), ("alone", "t5"), ("none", "t6")], "work string, topic string")
    tp = spark.createDataFrame([("t0", "a"), ("t1", "b"), ("t2", "b"), ("t3", "c"), ("t9", "c"), ("t5", "d"), ("t6", None)], "topic string, parent string")
    w = spark.createDataFrame([("w0", "1"), ("w0", "2"), ("w1", None)], "work string, legal_id string")
    d = catalogue.topic_classes(wt, tp, w).collect()
    up = {r["work"]: set(r["parents"]) for r in d}
    links = {x: sum(1 for y in up if y != x and up[x] & up[y]) for x in up}
    assert {r["work"]: r["links"] for r in d} == links and links["w0"] > 20 and links["alone"] == 0 and len(d) == len(up) + 1
    some = catalogue.related_by_topic(wt, tp, w, spark.createDataFrame([("w0",), ("w1",)], "work string"))
    assert some.select("work", "other").distinct().count() == links["w0"] + links["w1"]


def test_results_are_not_deduplicated_by_shuffle(spark):
    """Citations unite an id's works in the row; memorials of acts in one issue shuffle no lists."""
    w = spark.createDataFrame([("a",), ("a/1",), ("b",)], "work string")
    c = spark.createDataFrame([("a/1/x", "a/1", "d"), ("b", "a", None), ("z", "z", None)], "source string, target string, description string")
    d = relations.citations_of(w, c)
    assert sorted((r["work"], r["source"]) for r in d.collect()) == [("a", "a/1/x"), ("a", "b"), ("a/1", "a/1/x"), ("b", "b")]
    assert "Union" not in d._jdf.queryExecution().optimizedPlan().toString()
    m = spark.createDataFrame([("x", "m1"), ("y", "m1"), ("y", "m2"), ("z", "m2")], "act string, memorial string")
    assert sorted(map(tuple, catalogue.memorial(m).collect())) == [("x", "m1", ["x", "y"]), ("y", "m1", ["x", "y", "z"]), ("z", "m2", ["y", "z"])]


def test_copies_are_found_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "ROWS", 100)
    t = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("s"), F.lit("p").alias("p"), F.col("id").cast("string").alias("o"))
    d = catalogue.explore_node(t.unionByName(t))
    assert d.where("direction = 'out'").count() == 150 and d.where("direction = 'in'").count() == 1000
    assert "RepartitionByExpression" in d._jdf.queryExecution().optimizedPlan().toString() and ", 40" in d._jdf.queryExecution().optimizedPlan().toString()


def test_gazette_pairs_are_not_shuffled(spark):
    """A pair that several drafts make comes once, and the join that makes pairs is the last step."""
    from juralake.operators import catalogue

    acts = spark.createDataFrame([("w", "a1"), ("w", "a2"), ("v", "a2"), (None, "a1")], "work string, act string")
    drafts = spark.createDataFrame([(d, a, r) for d, a in (("d1", "a1"), ("d2", "a2")) for r in ("x/eli/fga/1", "x/eli/oc/1", None)] + [("d2", "a2", "x/eli/fga/2"), (None, "a2", "x/eli/fga/3")], "draft string, act string, result string")
    results = spark.createDataFrame([("x/eli/fga/1", "g", None), ("x/eli/fga/1", "g", None), ("x/eli/fga/1", "h", "t")], "doc string, genre string, date string")
    d = catalogue.gazette_documents(acts, drafts, results, None)
    one = [("x/eli/fga/1", "g", None), ("x/eli/fga/1", "h", "t")]
    assert sorted(map(str, map(tuple, d.collect()))) == sorted(map(str, [(w, *r) for w in ("w", "v", None) for r in one] + [(w, "x/eli/fga/2", None, None) for w in ("w", "v")]))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
