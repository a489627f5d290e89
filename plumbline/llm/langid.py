"""Language identification by segmentation-marginalised unigrams.

For each language of the documents' lang column the probabilities of the pieces of
a fixed public vocabulary are fitted on SAMPLE documents of it in expectation, each
taken or not by a hash of its id (the one bound here: the fit of the classifier): two
steps of expectation-maximisation from the vocabulary's scores. A text's likelihood in a
language is the sum over all its segmentations, by the forward algorithm, over
the whole text.

Defined results: a text null or without a word gets predicted null. Ties go to the
first language by name. A null lang takes no part in the fit and is predicted like
others; with no language known, predicted is null. Repeated rows give a row each;
an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bounded, chunks, column, documents, stored
from plumbline.llm.lattice import VOCABULARY, Memo, re_estimated, vocabulary_of, with_unknown, word_counts, word_scores

SAMPLE, STEPS = 1000, 2
ORACLE_SQL = None


def fitted(docs: DataFrame, path: str = VOCABULARY, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {x.lang: x["count"] for x in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(sample / n)) for k, n in sorted(sizes.items())])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    words = stored(word_counts(rows.where(draw), "lang"))
    models = {k: vocabulary_of(path).log_p for k in sizes}
    for _ in range(STEPS):
        models = re_estimated(words, "lang", path, models)
    return models


def identified(docs: DataFrame, models: dict[str, np.ndarray], path: str = VOCABULARY) -> DataFrame:
    """doc_id, lang, predicted, log_p (of a character, in the predicted language) and
    margin (by how much a character is likelier than in the next one)."""
    held = docs.sparkSession.sparkContext.broadcast((path, models))

    def score(batches):
        path, models = held.value
        names = sorted(models)
        vocabulary, log_ps = vocabulary_of(path).open(), [with_unknown(models[k]) for k in names]
        memo = Memo()
        for batch in batches:
            size = batch.num_rows
            best, p, margin = np.full(size, -1), np.full(size, np.nan), np.full(size, np.nan)
            for first, texts in chunks(column(batch, "text").to_pylist()):
                if not names:
                    break
                scores, letters = word_scores(vocabulary, texts, log_ps, memo)
                some = np.flatnonzero(letters)
                rate = scores[some] / letters[some, None]
                win = rate.argmax(1)
                at = first + some
                best[at], p[at] = win, rate[np.arange(len(some)), win]
                if len(names) > 1:
                    margin[at] = p[at] - np.partition(rate, -2, 1)[:, -2]
            predicted = pa.array([names[k] if k >= 0 else None for k in best], pa.string())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), predicted, pa.array(p, from_pandas=True), pa.array(margin, from_pandas=True)], ["doc_id", "lang", "predicted", "log_p", "margin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "lang", "text").mapInArrow(score, f"doc_id {kind}, lang string, predicted string, log_p double, margin double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs, fitted(docs))
