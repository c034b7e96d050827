"""The pipeline's stages against brute force, and as a whole."""

import duckdb

from tallyframe.llm import mixing

import corpus_pipeline
from tallyframe.llm.common import stored

from ..conftest import SF
from .test_operators import near


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, kept[-1], SF), name)
        if name != "packing":
            assert out.columns == columns
        kept.append(out)
    raw, clean, single, apart, mixed, packed = kept
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    assert ids(clean) < ids(raw) and toxic <= ids(clean)
    text = {r["doc_id"]: " ".join(r["text"].split()) for r in clean.collect()}
    first: dict = {}
    for i in sorted(text):
        first.setdefault(text[i], i)
    assert abs(len(ids(single)) - len(first)) <= 1 and ids(single) <= set(text)
    expected = {i for i, _, c in near([(r["doc_id"], r["text"]) for r in single.collect()], 5, 8, 10) if i == c}
    assert ids(apart) == expected
    assert ids(mixed) < ids(apart) and ids(mixed) == {r["doc_id"] for r in mixing.mix(apart, mixing.source_domain(apart["source"]), mixing.WEIGHTS, 80, 1).collect()}
    assert ids(packed) == ids(mixed)


def test_copies_of_repeated_rows(spark):
    cases = [(1, "a b", 1), (1, "a  b", 2), (2, "a b", 3), (2, "other", 4), (3, "x", 5), (3, "x", 6), (3, "y", 7), (None, "z", 8), (None, "z", 9), (4, "z", 10), (5, None, 11), (6, "", 12), (None, "w", 13)]
    out = corpus_pipeline.drop_copies(spark, spark.createDataFrame(cases, "doc_id long, text string, no int"), SF)
    assert out.columns == ["doc_id", "text", "no"]
    found = sorted((str(r["doc_id"]), " ".join((r["text"] or "").split())) for r in out.collect())
    assert found == sorted([("1", "a b"), ("2", "other"), ("3", "x"), ("3", "y"), ("None", "z"), ("5", ""), ("None", "w")])


def test_mixing_stage_keeps_an_independent_budget(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    once = mixing.ORACLE.replace("* 2 AS cap", "* 1 AS cap")
    assert once != mixing.ORACLE
    expected = sorted(r[0] for r in db.sql(f"SELECT doc_id FROM ({once})").fetchall())
    out = corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == expected


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert out.count() > 0
