"""The corpus pipeline: from ``documents`` to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import encode_documents
from quarry.llm.common import table, written
from quarry.llm.decontam import without_contaminated
from quarry.llm.jaccard import first_of_classes
from quarry.llm.linedup import dedup_lines
from quarry.llm.quality import fit, score_documents

#: A document stays if its score is at least this.
LEAST_SCORE = 0.3
#: A line goes from all documents but the first if at least so many different texts hold it.
LINE_DOCUMENTS = 10
#: Near duplicates: words in a shingle, and percent of the union.
SHINGLE, PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of documents that aren't held out.

    Null and empty texts have the score of the bias. Rows with null or repeated ids are judged one by one. Columns stay as they are,
    whatever their names; an empty table stays empty.
    """
    column = "score"
    while column in docs.columns:
        column += "_"
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), column)
    return scored.where(F.col(f"`{column}`") >= LEAST_SCORE).select(*(F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many hold, but for each one's first occurrence; ``n_chars`` follows the text. No document goes.

    Documents with equal texts count as one holder and stay equal, so that the next stage still finds them; of a line
    that ten different texts hold, the first text keeps it. Null and empty texts become empty ones. Rows that share an id
    each keep their own text. Columns stay as they are, whatever their names; an empty table stays empty.
    """
    out = dedup_lines(docs, LINE_DOCUMENTS, keep="first", copies="one", counts=False)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    A document without words, a null or empty one included, is a group of its own. Rows with a null id are left alone. Rows that
    share an id are judged by their own texts; equal ones stay or go together. Columns stay as they are; an empty table stays empty.
    """
    return first_of_classes(docs, SHINGLE, PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.

    Null, empty and very short texts stay, unless an item is as short. Rows with null or repeated ids are judged by their own texts.
    Columns stay as they are; an empty table, or an empty benchmark, takes nothing away.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): each document's ids, and the digest of the bytes that they decode to.

    Null and empty texts have no ids. Each row gives a row, with its id as it is; other columns go. An empty table stays empty.
    """
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ("doc_id", "n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", bpe_encoding),
]

#: A trained classifier is no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
