"""The pipeline: contract, stage by stage against brute force, and all of it."""

import pytest

import corpus_pipeline
from juralake.llm import minhash
from tests.llm.conftest import SCHEMA, words
from tests.llm.test_operators import brute_groups, brute_repeats, norm

SF = "/root/testdata/sf0.001"


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = docs
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    for name in list(stages)[:-1]:
        assert stages[name].columns == stages["documents"].columns, name


def test_near_dedup(stages):
    before, after = texts(stages["toxicity"]), texts(stages["minhash_near_dedup"])
    drop = {i for g in brute_groups(before, minhash.THRESHOLD) for i, _ in g[1:]}
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert gone <= drop and len(gone) >= 0.9 * len(drop)


def test_repeats_are_cut(stages):
    before, after = dict(texts(stages["minhash_near_dedup"])), dict(texts(stages["suffix_array_dedup"]))
    cut = {i: c for (i, _), (_, c) in brute_repeats(list(before.items()), 50).items()}
    for i, t in before.items():
        want = [w for k, w in enumerate(t.split()) if k not in cut.get(i, ())]
        assert after.get(i, "").split() == want
    for r in stages["suffix_array_dedup"].collect():
        if cut.get(r["doc_id"]):
            assert r["n_chars"] == len(r["text"])


def test_no_benchmark_left(spark, stages):
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = dict(texts(stages["suffix_array_dedup"])), dict(texts(stages["benchmark_decontamination"]))
    dirty = {i for i, t in before.items() if any(x in norm(t) for x in items)}
    assert not dirty & set(after) and len(set(before) - set(after) - dirty) <= 0.02 * len(before)


def test_all_is_packed(stages):
    assert {r["doc_id"] for r in stages["packing"].select("doc_id").distinct().collect()} == {i for i, t in texts(stages["benchmark_decontamination"]) if t}


def test_run_equals_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages["packing"].collect()))


def test_messy_stages(spark, messy, tmp_path):
    import random

    rng = random.Random(1)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(rng, 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = messy
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0
    none = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, str(tmp_path)).count() == 0
