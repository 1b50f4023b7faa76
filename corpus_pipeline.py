"""A corpus pipeline of five stages: toxicity, quality, near duplicates, repeats, packing.

Each stage takes the documents that the stage before kept and returns documents with
the same columns; the last returns the packed pieces. Toxicity and quality judge each
row by itself, whatever its id. Near duplicates tells rows apart by id and words; rows
without an id are never duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.llm import minhash, packing, quality, substrings, toxicity
from ontomill.llm.common import table
from ontomill.operators.stats import number_rows
from ontomill.sources.scratch import Scratch

#: Repeated words in a hundred from which on a text is rejected.
MAX_REPEATED = 50
ROOM, END_ID = 4096, 1


def _free(docs: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """``docs`` as ``_row`` beside ``_doc``, a number for each document in the order of ids.

    It is the id itself unless an id has several texts; these are documents of their own.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    doc, text = F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text")
    known = docs.select(doc, text).filter("_id is not null")
    several = known.groupBy("_id").agg((F.min("_text") != F.max("_text")).alias("_several"))
    if several.filter("_several").isEmpty():
        return docs.select(row, doc.alias("_doc"))
    names = number_rows(known.distinct().withColumn("_all", F.lit(0)), "_all", "_id", "_text")
    names = scratch.cut(names.select("_id", "_text", F.col("num").cast("long").alias("_doc")))
    return docs.select(row, doc, text).join(names, ["_id", "_text"], "left").select("_row", "_doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic by the limit of their language go."""
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.clean_rows(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents out of their compression band, or mostly of repeated words, go."""
    bands = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.good_rows(docs, bands, MAX_REPEATED)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row with the smallest id stays.

    Different texts that share an id are different documents. Rows of one id without
    words are one document. Of texts with the same id and shingles the smallest stays.
    """
    scratch = Scratch(spark)
    own = _free(docs, "_set")
    keyed = scratch.cut(minhash.keyed(docs, 5, own))
    sets = keyed.filter(F.col("doc_id").isNotNull() & F.col(own).isNotNull()).groupBy(
        F.col(own).alias("_own")
    ).agg(F.min("doc_id").alias("_least"))
    comps = minhash.class_components(docs, size=5, percent=80)
    first = F.min(F.struct("_least", "_own")).alias("_first")
    kept = sets.join(comps, F.col("_own") == F.col("node")).groupBy("comp").agg(first)
    kept = scratch.cut(kept.select(F.col("_first._least").alias("_id"), F.col("_first._own").alias("_own")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = keyed.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.col(own).alias("_own"))
    with_words = rows.join(kept, ["_id", "_own"], "left_semi")
    once = with_words.unionByName(rows.filter("_id is not null and _own is null"))
    text = F.coalesce(F.col("_row")["text"], F.lit(""))
    once = once.groupBy("_id", "_own").agg(F.min_by("_row", text).alias("_row")).select("_row")
    whole = once.unionByName(rows.filter("_id is null").select("_row"))
    return whole.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that an earlier document has too go; n_chars follows the text.

    A document that loses nothing keeps its text as it is. No row goes.
    """
    numbered = _numbered(Scratch(spark), docs)
    texts = numbered.select(F.col("_doc").alias("doc_id"), F.col("_row.text").alias("text"))
    left = substrings.remove_repeated(texts, size=13).filter("n_removed > 0")
    left = left.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = numbered.join(left.dropDuplicates(["_id"]), F.col("_doc") == F.col("_id"), "left")
    changed = F.col("_text").isNotNull()
    row = F.col("_row")
    new = {"text": F.coalesce("_text", row["text"])}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("_text").cast(kind)).otherwise(row["n_chars"])
    return joined.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in token sequences of a fixed length."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(docs, vocabulary, ROOM, END_ID), ROOM)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("packing", pack),
]

#: Neither the trained classifier nor the tokenizer can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
