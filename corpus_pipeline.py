"""A corpus pipeline in five stages, each written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of documents; n_chars follows the text that a stage leaves.

Cases: null texts and texts without a letter go in the first stage. Rows that repeat a doc_id count as one
document for near duplicates and repeats: all stay or all go, and each is packed. Rows with a null doc_id
stay, but are never taken for duplicates. Texts of any length, columns of any further names, and empty
tables, which give empty results, pass all stages.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.base import fresh_dir, table
from weft.llm.decontaminate import find_contamination
from weft.llm.files import remove_dir
from weft.llm.language import identify, train
from weft.llm.near_duplicates import keep_one_of_each
from weft.llm.packing import pack_documents
from weft.llm.queries import tokenizer
from weft.llm.repeated_spans import remove_repeats


#: Documents whose language is predicted with a smaller score are rejected.
LEAST_SCORE = 1 / 3
#: Columns that operators add.
LANGUAGE_COLUMNS = ("held_out", "lang_pred", "score")
REPEAT_COLUMNS = ("n_sentences", "n_removed", "cleaned")
CONTAMINATION_COLUMNS = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "cleaned", "dropped")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is told, with it as their lang; und and predictions of a score below LEAST_SCORE go.

    If no row has a lang, nothing can be learnt, and documents with a letter stay as they are.
    """
    model = train(docs)
    if not model.families:
        return docs.where(F.regexp_like(F.col("text").cast("string"), F.lit(r"\p{L}")))
    told = identify(_aside(docs, LANGUAGE_COLUMNS), model)
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*_back(docs.columns, LANGUAGE_COLUMNS, {"lang": F.col("lang_pred")}))


def _aside(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """docs with columns of these names, which an operator would replace, under other ones."""
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in names})


def _back(columns: list[str], names: Iterable[str], new: dict[str, Column]) -> list[Column]:
    """columns as they were before _aside, those in new anew."""
    return [new.get(c, F.col(f"__own_{c}" if c in names else c)).alias(c) for c in columns]


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate class."""
    return keep_one_of_each(docs)


def _with_text(df: DataFrame, columns: list[str], names: Iterable[str]) -> DataFrame:
    """df's columns with cleaned as the text; documents of which nothing but white space is left go."""
    changed = ~F.col("text").eqNullSafe(F.col("cleaned"))
    new = {"text": F.col("cleaned")}
    if "n_chars" in columns:
        new["n_chars"] = F.when(changed, F.length("cleaned").cast("long")).otherwise(F.col("n_chars"))
    return df.where(~changed | (F.trim("cleaned") != "")).select(*_back(columns, names, new))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove sentences that repeated runs cover, and repeated passages, but in their first place."""
    return _with_text(remove_repeats(_aside(docs, REPEAT_COLUMNS)), docs.columns, REPEAT_COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove what occurs in the benchmark, and documents that mostly consist of it."""
    found = find_contamination(_aside(docs, CONTAMINATION_COLUMNS), table(spark, sf_dir, "benchmark"))
    return _with_text(found.where("not dropped"), docs.columns, CONTAMINATION_COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 2048."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]

#: SQL can't express the learnt, hashed and greedy stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each from what the one before has written to the shared folder; a folder goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        at = fresh_dir(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove_dir(before)
        before = at
    return docs
