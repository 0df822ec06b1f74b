"""A cleaning pipeline over ``documents``: five stages, each one operator of adloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result
as Parquet in the shared checkpoint folder and reads it again for the next stage.  All but
the last return the columns of ``docs``, whatever they are.

1. toxicity        trains on the labelled documents that came in; rows scored >= 0.5 go
2. jaccard_join    of each class of near duplicates the row with the smallest (doc_id, hash of
                   the text) stays
3. secret_scan     spans found are replaced by a mark; n_chars follows
4. mixing          whole documents only: a document comes once for each time it is taken,
                   documents the mix leaves out go
5. byte_bpe        ids of the remaining texts, decoded again

An empty table, or one of nulls only, passes every stage: texts that are null have a score,
no shingles and no words, stay in stages 1 to 3 and are left out by the mix.  Columns beside
doc_id, text, source and n_chars are carried, whatever their names; names that begin with two
underscores are the stages' own.  Repeated rows: stage 2 keeps one, later stages treat a
repeated row as it comes.

Stage 2 decides by id and text, so different documents with one id stay.  Of the rows with a
null doc_id it keeps one of each class, beside the class's row with an id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.llm.bpe import bpe_round_trip
from adloom.llm.common import join_few, ship
from adloom.llm.jaccard_join import jaccard_rows
from adloom.llm.mixing import mix_sources
from adloom.llm.secrets import redact
from adloom.llm.toxicity import score_texts, train_toxicity
from adloom.session import materialize, stage_scope

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels)
    scored = score_texts(docs.select("doc_id", F.xxhash64("text").alias("__th"), "text"), model, carry=("doc_id", "__th"), name="__score")
    # only ids and text hashes come back from Python; equal rows have equal scores
    gone = materialize(scored.filter("__score >= 0.5").select(F.col("doc_id").alias("__id"), "__th").distinct(), "toxic")
    return join_few(docs, gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left_anti")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = materialize(jaccard_rows(docs).filter("n_shingles > 0").select("doc_id", "th", "component"), "components")
    best = rows.groupBy(F.col("component").alias("__c"), F.col("doc_id").isNull().alias("__none")) \
        .agg(F.min(F.struct("doc_id", "th")).alias("__k"), F.max(F.struct("doc_id", "th")).alias("__last")).filter("__k <> __last")
    lost = join_few(rows, best, (F.col("component") == F.col("__c")) & (F.col("doc_id").isNull() == F.col("__none"))) \
        .filter(~F.col("doc_id").eqNullSafe(F.col("__k.doc_id")) | (F.col("th") != F.col("__k.th")))
    row = lambda found: found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    kept = join_few(docs, materialize(row(lost), "gone"), same, "left_anti")
    # equal rows (id and text): one of them stands for all
    twice = materialize(row(rows.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")), "twice")
    if twice.isEmpty():
        return kept
    return join_few(kept, twice, same, "left_anti") \
        .unionByName(join_few(kept, twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    th = F.xxhash64("text")
    mixed = mix_sources(docs.select("doc_id", "source", "text", th.alias("__th")), last="nearest", carry=("__th",))
    times = mixed.filter("taken > 0").groupBy("doc_id", "__th") \
        .agg(F.sum((F.col("taken") / F.col("size")).cast("int")).alias("__times"), F.count(F.lit(1)).alias("__rows"))
    times = materialize(times.select(F.col("doc_id").alias("__id"), "__th", "__times", "__rows"), "times")
    joined = join_few(docs, times, F.col("doc_id").eqNullSafe(F.col("__id")) & (th == F.col("__th")))
    # equal rows share a count: one of them stands for all
    once = joined.filter("__rows = 1").unionByName(joined.filter("__rows > 1").dropDuplicates(["doc_id", "text"]))
    return once.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("secret_scan", secret_scan),
          ("mixing", mixing), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = ship(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with stage_scope(spark) as tables:           # what a stage wrote, and its input, go when its result is there
            tables += [before] if before else []
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            before = tables.pop()
    return docs
