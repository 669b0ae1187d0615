"""Quality rules: base counts of words, symbols and repeats, then a calibrated classifier.

The classifier is a logistic regression of hashed word and character n-grams, trained on at most
``SAMPLE`` labelled texts of each class and Platt-scaled on a quarter of them, scored in Arrow batches
against the fixed threshold ``KEEP``. A row is kept when the base rules pass and its
probability of good quality reaches ``KEEP``.

Null and empty texts have no words and fail. Repeated rows count each and get equal results. Very long texts are read whole, in linear
time but for sorting their windows. A probability equal to ``KEEP`` is kept; of an id with several labelled texts the least one trains. An empty table gives an
empty result; without labels of both classes the probability is the label's smoothed share. Extra columns, whatever their names, are ignored by
``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import filter_rows, map_text, table, windows, word_hashes
from .linear import HashedLinear, fit_sample, labelled_sample

#: Labelled texts of each class at most; probability from which a text is kept.
SAMPLE, KEEP = 1500, 0.3
#: Fewest words; most hundredths of the words in repeated windows; words of a window.
MIN_WORDS, MAX_REPEAT_PCT, WINDOW = 20, 30, 8

_SPACES = "\t\n\x0b\x0c\r "
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(_SPACES.encode())] = True


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode()
    b = np.frombuffer(raw, np.uint8)
    words = word_hashes(raw)
    chars = len(text) - int(np.count_nonzero(_BLANK[b]))
    symbols = int(np.count_nonzero(_SYMBOLS[b]))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    w = windows(words, WINDOW)
    if len(w) > 1:
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w) + 1, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(twice)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeat = int(np.count_nonzero(np.cumsum(cover)[:-1]))
    return len(words), chars, symbols, dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """Too few words, or too large a share of them in repeated windows."""
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PCT * n_words


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> HashedLinear:
    """The calibrated classifier of the ``quality`` label."""
    model = HashedLinear(sizes=(2, 3, 4), words=True, lower=False, log_ratio=False, bits=18, smooth=0, step=0.03, passes=6)
    return fit_sample(model, labelled_sample(docs, labels, "quality", sample), calibrate=0.25)


def judge(docs: DataFrame, model: HashedLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base counts, base_failed, probability and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(ids: list, texts: list) -> dict:
        counts = [base_counts(t) for t in texts]
        failed = [base_failed(c[0], c[4]) for c in counts]
        p = [shared.value.score(t) for t in texts]
        return {id_col: ids} | {n: [c[k] for c in counts] for k, n in enumerate(names)} | {"base_failed": failed, "probability": p, "kept": [not f and x >= KEEP for f, x in zip(failed, p, strict=True)]}

    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, probability double, kept boolean"
    return map_text(docs, run, schema, id_col, text_col)


def keep_good(docs: DataFrame, model: HashedLinear, text_col: str = "text") -> DataFrame:
    """The kept rows, all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[str]) -> list[bool]:
        out = []
        for t in texts:
            c = base_counts(t)
            out.append(not base_failed(c[0], c[4]) and shared.value.score(t) >= KEEP)
        return out

    return filter_rows(docs, good, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
