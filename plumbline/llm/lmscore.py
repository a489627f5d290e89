"""Language-model scores by subword lattice likelihood.

The pieces of an existing unigram-style vocabulary weigh all segmentations of a
text; the log-space forward recursion gives the text's marginal probability. The
vocabulary's own scores are ranks of merges, not probabilities: they are read by
Zipf's law and re-weighted by one step of expectation-maximisation over the words
of all documents, which Spark counts. The words counted grow with the input.

Defined results: a text null or without a word gets null scores. Repeated rows give
a row each and count as often in the fit; an empty table gives no rows. The order
of rows makes no difference but for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, chunks, column, documents, stored
from plumbline.llm.lattice import VOCABULARY, Memo, re_estimated, vocabulary_of, with_unknown, word_counts, word_scores

ORACLE_SQL = None


def fitted(docs: DataFrame, path: str = VOCABULARY) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces over all words of docs."""
    words = stored(word_counts(docs.select(F.lit("all").alias("key"), "text"), "key"))
    return re_estimated(words, "key", path, {"all": vocabulary_of(path).log_p})["all"]


def scored(docs: DataFrame, log_p: np.ndarray, path: str = VOCABULARY) -> DataFrame:
    """doc_id, log_p (natural log of the marginal probability), chars (a mark for each
    word included) and bits_per_char."""
    held = docs.sparkSession.sparkContext.broadcast((path, log_p))

    def score(batches):
        path, log_p = held.value
        vocabulary, log_p = vocabulary_of(path).open(), with_unknown(log_p)
        memo = Memo()
        for batch in batches:
            total, chars = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, texts in chunks(column(batch, "text").to_pylist()):
                scores, letters = word_scores(vocabulary, texts, [log_p], memo)
                total[first : first + len(texts)], chars[first : first + len(texts)] = scores[:, 0], letters
            with np.errstate(all="ignore"):
                bits = np.where(chars > 0, -total / np.log(2) / chars, np.nan)
            total[chars == 0] = np.nan
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(total, from_pandas=True), pa.array(chars), pa.array(bits, from_pandas=True)], ["doc_id", "log_p", "chars", "bits_per_char"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, log_p double, chars long, bits_per_char double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fitted(docs))
