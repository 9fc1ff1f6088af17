"""Pipeline stages on documents with further columns of any names, with nulls, repeats and no rows at all."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

import corpus_pipeline
from tidemark.llm import bytebpe, common, langid, licenses, simhash, tokencount

ODD = ["my col", "a-b", "row_number_", "row", "key", "__m", "a.b", "Text ", "source_size", "copies", "h", "fp", "lang_pred", "kept", "n_words", "component_id"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), *[StructField(c, IntegerType()) for c in ODD]])


@pytest.fixture(scope="module")
def odd(spark):
    found = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(*r, *range(len(ODD))) for r in found] + [(None, None, None, None, None, *[None] * len(ODD)), (*found[0], *range(len(ODD))), (9999, "", "en", "src0", 0, *range(len(ODD)))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_each_stage_keeps_columns(spark, odd, name, stage):
    out = stage(spark, odd, "")
    if stage is corpus_pipeline.byte_bpe:
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == odd.count()
        return
    assert out.schema == SCHEMA
    found = out.collect()
    assert found and all(r["a-b"] is None or list(r)[5:] == list(range(len(ODD))) for r in found)
    plain = stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert sorted(map(str, (r[:5] for r in map(tuple, found)))) == sorted(map(str, map(tuple, plain.collect())))
    assert stage(spark, odd.limit(0), "").count() == 0


def test_the_whole_pipeline_on_odd_columns(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/plain/documents.parquet")
    want = corpus_pipeline.run(spark, f"{tmp_path}/plain")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() > 10


def test_operators_take_any_key(spark):
    df = spark.createDataFrame([("x", "the old mill of the town", 1), (None, None, 2)], StructType([StructField("doc_id", StringType()), StructField("text", StringType()), StructField("a-b", IntegerType())]))
    whole = df.select(F.struct("*").alias("my key"), "text")
    for f in (
        lambda: simhash.fingerprints(whole, "my key"), lambda: bytebpe.encode(whole, "my key"), lambda: tokencount.token_counts(whole, "my key"), lambda: licenses.license_scan(whole, "my key"),
        lambda: langid.predict(whole, langid.learn(df.select(F.col("doc_id").alias("key"), "text", F.lit("en").alias("lang"))), "my key"),
    ):
        out = f()
        assert out.columns[0] == "my key" and sorted(str(r[0]["doc_id"]) for r in out.collect()) == ["None", "x"]


def test_free_names():
    assert common.free_name(["A", "a_"], "a") == "a__" and common.free_name([], "a") == "a"
