"""Registered queries equal their SQL twins; the pipeline's stages do what they say."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import connect, differences
from matchframe.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_matches_sql(spark, con, name):
    run, sql = QUERIES[name]
    assert differences(run(spark, SF).toPandas(), con.execute(sql).df()) == []


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_covers_its_table(spark, name):
    key, source = ("page_id", "pages") if name.startswith("op3") else ("doc_id", "documents")
    got = QUERIES[name][0](spark, SF)
    want = spark.read.parquet(f"{SF}/{source}.parquet")
    assert got.count() == want.count() and got.select(key).exceptAll(want.select(key)).count() == 0


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = spark.createDataFrame([(10**9, "123 456", "en", "src0", 7), (10**9 + 1, None, "en", "src0", 0)], docs.schema)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    leak = spark.createDataFrame([(10**9 + 2, f"before {bench} after", "en", "src0", 0)], docs.schema)
    docs = docs.union(junk).union(leak)
    kept, columns = docs, docs.columns
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept, SF).write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        left.append({r[0] for r in kept.select("doc_id").collect()})
        if k < 4:
            assert kept.columns == columns
    everything = {r[0] for r in docs.select("doc_id").collect()}
    assert everything - left[0] == {10**9, 10**9 + 1}
    assert left[1] == left[0] and left[4] == left[3]
    assert 10**9 + 2 in left[2] and 10**9 + 2 not in left[3]
    assert kept.where(~F.col("round_trip")).count() == 0
    assert len(left[3]) > 0.7 * len(everything)


def test_pipeline_with_repeated_and_null_ids(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("doc_id"))).withColumn("row_id", F.lit("x"))
    counts = []
    for name, given in (("once", docs), ("twice", twice)):
        given.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
            place = str(tmp_path / f"{name}{k}")
            stage(spark, kept, SF).write.parquet(place)
            kept = spark.read.parquet(place)
            assert kept.columns == given.columns
        counts.append(kept.count())
        assert kept.groupBy("text").count().where("count > 1").count() == 0
        ids = kept.where("doc_id IS NOT NULL")
        assert ids.count() == ids.distinct().count()
    # The same texts stay, though another member may stand for its group.
    assert abs(counts[0] - counts[1]) <= 2


def test_same_id_with_other_texts_and_rows_without_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (1, b), (1, b), (2, a + " x"), (None, b), (None, "c " * 30), (None, "c " * 30), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(got) == 5 and (2, a + " x") in got and (3, None) in got and (4, "") in got and (None, "c " * 30) in got
    assert sum(t == b for _, t in got) == 1 and (1, a) not in got


@pytest.mark.parametrize("number", range(5))
def test_stages_on_empty_tables(spark, number):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row_id string")
    assert corpus_pipeline.STAGES[number][1](spark, docs, SF).count() == 0


def test_run_equals_its_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "sentencepiece"]
