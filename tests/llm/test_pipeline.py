import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.row.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    clean = corpus_pipeline.reject_toxic(spark, docs, sf)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, s in scores.items() if s < 0.5)
    single = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert single.columns == docs.columns

    kept = {r.doc_id for r in single.collect()}
    assert len(kept) < docs.count()
    assert single.groupBy("text").count().where("count > 1").count() == 0
    cut = corpus_pipeline.cut_repeats(spark, single, sf)
    assert cut.columns == docs.columns and cut.count() == single.count()
    assert cut.where(F.col("n_chars") != F.length("text")).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, cut, sf)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 3").count() == 0


def test_null_rows(spark, make, sf):
    docs = make([None, "", "a b c d e f", None], [None, 1, 2, 3])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() <= 6
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_extra_columns_stay(make, sf, spark):
    docs = make(["a b c d e f g", "h i j k l m n", None]).withColumn("code", F.lit(1)).withColumn("row", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert {"code", "row"} <= set(out.columns)


def test_most_words_of_the_last_stage_stay_out_of_the_literal(spark, make, sf):
    docs = make([" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(9000))] * 2)
    out = corpus_pipeline.encode(spark, docs, sf)
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 16)
    assert "Subquery" in plan and corpus_pipeline.WORDS < corpus_pipeline.MORE


def test_no_constant_of_the_last_stage_is_in_a_plan(spark, make, sf):
    """Ranks and words are subqueries over tables, and the ids are the library's, with lists and without."""
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.rank_table(), special_tokens={})
    for texts in (["one", None, ""], [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x été" for i in range(9000))] * 2):
        out = corpus_pipeline.encode(spark, make(texts), sf)
        spark.conf.set("spark.sql.maxPlanStringLength", 1 << 30)
        plan = out._jdf.queryExecution().toString()
        spark.conf.set("spark.sql.maxPlanStringLength", byte_bpe.PLAN_TEXT)
        assert len(plan) < 1 << 20 and "Subquery" in plan and f" AS {byte_bpe.LISTS}" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: r.ids for r in out.collect()} == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}
