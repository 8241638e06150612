"""From id and date to text."""

from pyspark.sql import functions as F

from juralake.operators import bridge
from juralake.plans.context import QueryStamp

ACT = '<akomaNtoso><act><body><article eId="art_1"><num>Art. 1</num><content><p>{}</p></content></article>{}</body></act></akomaNtoso>'


def test_read_and_compare(spark):
    cons = spark.createDataFrame([("w", "a", "2018-01-01"), ("w", "b", "2023-01-01")], "work string, cons string, date string").withColumn("date", F.col("date").cast("date"))
    ex = spark.createDataFrame([("a", "xa", "de"), ("b", "xb", "de")], "cons string, expr string, lang string")
    ma = spark.createDataFrame([("xa", "h/xml/1"), ("xb", "h/xml/2")], "expr string, url string")
    files = spark.createDataFrame([("h/xml/1", ACT.format("old", "")), ("h/xml/2", ACT.format("new", '<article eId="art_2_a"><num>Art. 2a</num></article>'))], "url string, xml string")
    q = spark.createDataFrame([("w", "art_1"), ("w", "art_2a"), ("w", "art_9"), ("none", "art_1")], "work string, eid string")
    r = {(x["work"], x["requested"]): x for x in bridge.read_articles(q, cons, ex, ma, files, QueryStamp.make("2024-01-01")).collect()}
    assert r["w", "art_1"]["text"] == "Art. 1 new" and r["w", "art_2a"]["eid"] == "art_2_a"
    assert r["w", "art_9"]["error"] == "NotFound(element)" and r["none", "art_1"]["error"] == "NotFound(version)"
    assert all(x["provenance"] is not None for x in r.values())
    d = bridge.compare_at(q.select("work"), cons, ex, ma, files, QueryStamp.make("2024-01-01"), QueryStamp.make("2020-01-01")).collect()
    assert [(x["added"], x["changed"], x["removed"]) for x in d] == [(["art_2_a"], ["art_1"], [])]


def test_articles_are_parsed_once_and_only_what_is_asked_for_is_kept(spark, monkeypatch):
    cons = spark.createDataFrame([("w", "a", "2018-01-01")], "work string, cons string, date string").withColumn("date", F.col("date").cast("date"))
    ex, ma = spark.createDataFrame([("a", "xa", "de")], "cons string, expr string, lang string"), spark.createDataFrame([("xa", "h/xml/1")], "expr string, url string")
    note = '<article eId="art_2"><authorialNote eId="n_1" marker="*"><p>Was <ref href="h">AS 1</ref></p></authorialNote><p>two</p></article><article eId="art_3"/>'
    files, q = spark.createDataFrame([("h/xml/1", ACT.format("old", note))], "url string, xml string"), spark.createDataFrame([("w", "art_2")], "work string, eid string")
    kept = []
    monkeypatch.setattr(bridge, "stored", lambda df, f=bridge.stored: kept.append(f(df)) or kept[-1])
    read = lambda: bridge.read_articles(q, cons, ex, ma, files, QueryStamp.make("2024-01-01")).drop("provenance")
    few = read()
    assert "MapInArrow" not in few._jdf.queryExecution().executedPlan().toString()
    assert {x["eid"] for x in kept[0].collect()} == {"art_2", "n_1", None}
    monkeypatch.setattr(bridge, "FEW_IDS", 0)
    every = read().collect()
    assert every == few.collect() and every[0]["text"] == "two" and every[0]["notes"][0]["refs"] == ["h"]
    assert "art_3" in {x["eid"] for x in kept[1].collect()}
