"""Toxicity: a linear classifier of hashed character n-grams scaled by naive Bayes log-count ratios.

Trained on at most ``SAMPLE`` labelled texts of each class, of rows outside the held-out fold; scored
over whole texts, also very long ones, in linear time. Labels, language, source and id are never features.

Null and empty texts score the logistic of the bias. Repeated rows are scored each; equal texts have equal scores. A score equal to ``THRESHOLD`` is toxic. Without
labels of both classes the score is the label's smoothed share; of an id with several labelled texts the least one trains. An empty table gives an
empty result. Extra columns, whatever their names, are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_rows, map_text, table
from .linear import HashedLinear, fit_sample, labelled_sample

#: Labelled texts of each class that training reads at most; score from which a text is toxic; held-out fold of FOLDS.
SAMPLE, THRESHOLD, FOLD, FOLDS = 2500, 0.5, 0, 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> HashedLinear:
    """The classifier of the ``toxic`` label."""
    return fit_sample(HashedLinear(sizes=(3, 4, 5, 6)), labelled_sample(docs, labels, "toxic", sample, FOLD, FOLDS))


def score(docs: DataFrame, model: HashedLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from THRESHOLD on) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(ids: list, texts: list) -> dict:
        scores = [shared.value.score(t) for t in texts]
        return {id_col: ids, "score": scores, "predicted": [int(s >= THRESHOLD) for s in scores]}

    return map_text(docs, run, f"{id_col} {dict(docs.dtypes)[id_col]}, score double, predicted int", id_col, text_col)


def drop_toxic(docs: DataFrame, model: HashedLinear, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that score under THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_rows(docs, lambda texts: [shared.value.score(t) < THRESHOLD for t in texts], text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == FOLD, F.lit(False)).alias("held_out"), "score", "predicted")
