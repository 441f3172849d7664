"""The pipeline's stages on odd rows: nulls, empties, repeats, clashing names, an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from . import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_lines long, score double"


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1], r[3], None if i % 5 == 0 else f"src{i % 2}", len(r[1] or ""), False, 7, 0.5) for i, r in enumerate(plain.documents())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    labels = [(r[0], int(i % 3 != 0), int(i % 7 == 0)) for i, r in enumerate(rows) if r[0] is not None and i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def key(r):
    return str(tuple(r))


def test_line_stage(spark, docs, rows, sf_dir):
    gone = plain.similar_lines(rows)
    got = corpus_pipeline.line_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = []
    for r in rows:
        mine = gone.get((2**63 - 1 if r[0] is None else r[0], r[1] or ""), set())
        left = "\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if k not in mine)
        if not mine:
            want.append((r[0], r[1]))
        elif left.strip():
            want.append((r[0], left))
    assert len(want) < len(rows)  # documents of nothing but copies go
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert got.where("n_chars <> length(text)").count() == 0


def test_near_duplicate_stage(spark, docs, rows, sf_dir):
    got = corpus_pipeline.near_dedup_stage(spark, docs, sf_dir)
    want = plain.near_duplicates(rows)
    kept = [r for r in rows if r[0] is None or want[r[0]][2]]
    assert got.columns == docs.columns and sorted(map(key, got.collect())) == sorted(map(key, kept))


def test_secret_stage(spark, docs, rows, sf_dir):
    got = corpus_pipeline.secret_stage(spark, docs, sf_dir).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)  # every document stays
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in rows:
        if r[1] is None or "token = " not in r[1]:
            assert r[1] in texts[r[0]]
        else:
            secret = r[1].split('token = "')[1][:40]
            assert all(secret not in t for t in texts[r[0]])


def test_packing_stage(spark, docs, rows, sf_dir):
    got = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    first = got.where("start = 0").agg(F.count("*"), F.sum("doc_tokens")).first()
    assert first[0] == len(rows) and got.agg(F.sum("length")).first()[0] == first[1]


def test_quality_stage_and_empty_tables(spark, docs, rows, sf_dir):
    got = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns
    mine = [key(r) for r in rows]
    kept = [key(r) for r in got.collect()]
    assert set(kept) <= set(mine) and len(kept) <= len(mine)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
