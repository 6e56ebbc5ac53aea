"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe, mixing, simhash, suffix_dedup, toxicity
from tilewright.plans.lineage import written

TOXIC_AT = 0.5
#: Words in the last stage's dictionary, in maps and in lists: fewer than alone, and by tables, as the driver has run four stages before it and keeps the text of literals with each plan.
WORDS, MORE = 1 << 13, 1 << 18


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5. It learns from the labelled rows of ``docs`` that aren't held out.

    Null and empty texts score the bias and stay. Texts are scored whole. Rows alike stay or go together, all columns
    stay, an empty table stays empty; without a labelled toxic row nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    scored = toxicity.score(docs, model)
    # without a model every score is the same and says nothing
    return scored.where(F.col("score") < TOXIC_AT).select("row.*") if model[0] else docs


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document with the smallest id.

    Wordless texts (null and empty too) are copies of each other; rows without an id come
    last. Different texts under one id, or without one, are different documents; of rows alike in
    both one stays. Texts are compared whole. All columns stay; an empty table stays empty.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters of 50-byte strings that also start in a smaller document. No row goes; a null text stays null.

    Texts are read whole, the longest in parts that overlap. Rows alike are cut alike up to the order of their ids: of
    those that share one nothing is cut for each other. All columns stay, ``n_chars`` anew where it is one; an empty table stays empty.
    """
    out = suffix_dedup.remove_repeats(docs, whole_chars=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept").cast("string"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix serves, as often as it serves them.

    Wordless texts are never served. A document is an id and a text, so different texts
    under one id, or without one, are served by themselves; rows alike in both are
    served equally often, their turns divided and rounded down. All columns stay; an empty table stays empty.
    """
    named = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("document"), "source", "text")
    turns = mixing.mix(named, id_col="document").where("size > 0").groupBy("document", "source").agg(F.expr("cast(sum(times) div count(*) as int)").alias("times")).where("times > 0")
    turns = turns.select(F.col("document").alias("of"), F.col("source").alias("from_source"), "times")
    served = named.join(turns, F.col("document").eqNullSafe(F.col("of")) & F.col("source").eqNullSafe(F.col("from_source")))
    return served.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_tokens`` and ``ids`` of every document in place of its text; none for a null or empty one.

    Whole texts are encoded, rows alike each by itself. All other columns stay (but for ones named as the new ones); an empty table stays empty.
    """
    encoded, _ = byte_bpe.encode(docs, words=WORDS, more=MORE, tables=True)
    return encoded.select(*[c for c in docs.columns if c.lower() not in ("text", "n_tokens", "ids")], F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mix sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Training and near copies are beyond SQL; tests compare near copies and repeats with brute force, the toxicity stage with its own scores and the mix by invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
