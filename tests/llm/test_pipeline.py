"""The corpus pipeline: stage order, schemas, and that decisions take effect."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(root / name))
        docs = spark.read.parquet(str(root / name))
        out.append(docs)
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secrets", "byte_bpe"]
    assert all(sorted(s.columns) == sorted(steps[0].columns) for s in steps[:-1])
    counts = [s.count() for s in steps]
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] == counts[5] > 0


def test_decisions_take_effect(spark, steps):
    from pixelspark.llm.decontamination import contamination
    from pixelspark.llm.jaccard import jaccard_components
    from pixelspark.llm.secrets_scan import scan_secrets

    comps = jaccard_components(steps[1])
    assert steps[2].count() == comps.select("component_id").distinct().count()
    assert jaccard_components(steps[2]).where("doc_id <> component_id").isEmpty()
    assert contamination(steps[3], spark.read.parquet(f"{DATA}/benchmark.parquet")).where("contaminated").isEmpty()
    assert scan_secrets(steps[4]).where("n_assign + n_access + n_hex > 0 and spans not rlike '\\\\['").isEmpty()
    assert steps[4].where(F.col("n_chars") != F.length("text")).isEmpty()


def test_run_equals_the_stages(spark, steps):
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DATA)) == key(steps[-1])


def test_odd_rows_survive(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, None, None), (4, "token=abcdefgh", "en", "s", 1)], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("stored", [False, True])
def test_rows_are_judged_one_by_one(spark, tmp_path, stored):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema

    def rows(*of):
        made = spark.createDataFrame([(i, t, None, None, None) for i, t in of], schema)
        if not stored:
            return made
        made.write.mode("overwrite").parquet(str(tmp_path))  # a file for each partition
        return spark.read.parquet(str(tmp_path))

    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    copy, own, twice = "a b c d e f", "clean words of its own here", "null twins with the same few words"
    docs = rows((7, copy), (9, copy), (None, copy), (None, own), (None, twice), (None, twice), (3, copy), (3, "another text under the same id"), (7, "kept although the other row goes"))
    expected = [(3, copy), (3, "another text under the same id"), (7, "kept although the other row goes"), (None, own), (None, twice)]
    assert left(corpus_pipeline.drop_near_copies(spark, docs, DATA)) == sorted(expected, key=repr)

    leak = max((r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()), key=len)
    docs = rows((None, leak), (None, own), (None, copy), (5, leak), (5, own), (6, copy))
    assert left(corpus_pipeline.drop_contaminated(spark, docs, DATA)) == sorted([(None, own), (None, copy), (5, own), (6, copy)], key=repr)


def test_registered_query_names():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 11))
