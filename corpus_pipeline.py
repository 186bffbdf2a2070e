"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage reads what the one before it wrote. All but the last return the columns of
documents; n_chars is kept right where a stage changes text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import langid, line_dedup, mixing, near_dups, packing, simhash
from tidewheel.llm.common import fresh_path, quoted, unused
from tidewheel.sources.shared import delete, scratch, write


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars set to the length of text, where there is such a column."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*map(quoted, columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (or text), and those far less likely than the training texts in every language.

    Where no row has a label to learn from, only documents without a letter go.
    """
    model = langid.train(docs, calibrate=True)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    language, score = unused(docs.columns, "language", "score")
    found = langid.identify(docs, model, tuple(docs.columns), (language, score))
    return found.where(F.col(language) != "und").select(*map(quoted, docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes common lines out of all but one document."""
    return _sized(line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)), docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more, verified."""
    return simhash.one_of_each(docs, near_dups.group(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken twice is there twice."""
    return _sized(mixing.mixed_documents(docs, mixing.mix(docs)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences whose lengths are powers of two."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Language ID, SimHash, the draws of the mix and tokenizers cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    What a stage stored, and the rows that it read, go once its own rows are written.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            write(out, path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last is not None:
            delete(spark, last)
        last = path
    return docs
