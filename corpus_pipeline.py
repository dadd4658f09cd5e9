"""A corpus pipeline: each stage calls one operator and hands a table of documents to the next.

1. language: documents whose language is rejected go (texts without letters, or with a score below the calibrated threshold).
2. near_copies: of each group of documents linked by a Jaccard similarity of 0.8 or more, one row with the smallest id stays.
3. secrets: documents with any secret go, row by row.
4. mixing: documents are taken as the mix takes them, once for each pass, in training order; documents it takes nothing of go.
5. tokens: doc_id, lang, source, n_tokens, ids_sha256 of every row.

``run`` applies them to the documents of a folder. Null and empty texts go at the first stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genorigin.llm import bpe, jaccard, langid, mixing, secrets
from genorigin.llm.common import read, stored
from genorigin.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose predicted language is not rejected, by a model learned from these documents. Null texts and texts without letters go; other rows are judged one by one, whatever their ids,
    repeated rows alike. An empty table learns nothing and keeps nothing; other columns than those of documents are left out."""
    model = langid.fit(docs)
    return langid.identify(docs, model).where("not rejected").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id (ids before none), of repeated rows any one. Each row without words (null, empty or blank text) is a group of its own.
    An empty table stays empty; other columns than those of documents are left out."""
    return jaccard.one_row_of_each(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without a secret in their own text, whatever their ids; null and empty texts have none. An empty table stays empty; other columns than those of documents are left out."""
    return secrets.without_secrets(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, once for each pass in which the mix takes words of them. A null source is a source; texts without words (null, empty or blank) are never taken; rows equal in id,
    text and source are used as often as the mix takes each. An empty table stays empty; other columns than those of documents are left out."""
    return mixing.curriculum(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids_sha256 of every row, repeated rows and passes alike. Null and empty texts have no tokens. An empty table stays empty."""
    coded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), tokenizer_path(), decode=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("tokens", tokens),
]

#: SQL cannot express the stages that learn a language model and merge BPE tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
