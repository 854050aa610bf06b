"""Operator 9, language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of every labelled text in one pass (each task
adds into one array per language, Spark sums the non-zero counts), so the model follows
all the labelled data.  The log-probability matrix has ``2**BITS`` rows and one column
per language; its size depends on these two alone, and it is broadcast.  Texts are scored
in numpy: a text's n-grams select their rows of the matrix, which are added up per text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revwise.llm.common import slices

BITS = 16
ORDERS = (1, 2, 3)
#: Added to each count of an n-gram that a language has.
SMOOTHING = 0.5
#: More labels than this are refused: the broadcast matrix is at most this many x 2**BITS x 4 bytes.
MAX_LANGUAGES = 256
UNDETERMINED = "und"
#: Code points looked at in one numpy step; longer texts take several steps.
STEP = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (2**BITS, languages), float32


def code_points(text: str) -> np.ndarray:
    """Lower-cased text between two blanks as code points."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)


def ngram_rows(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that starts at each position, as a row of the matrix."""
    h = np.full(max(0, len(points) - order + 1), order, dtype=np.uint64)
    for k in range(order):
        h = (h ^ points[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


def _steps(points: np.ndarray) -> Iterator[np.ndarray]:
    """Windows of a long text that overlap by the longest order less one."""
    keep = max(ORDERS) - 1
    for at in range(0, max(1, len(points) - keep), STEP):
        yield points[at:at + STEP + keep]


def rows_of(points: np.ndarray) -> Iterator[np.ndarray]:
    """All n-gram rows of a text, each n-gram once, in steps of bounded size."""
    last = len(points)
    at = 0
    for window in _steps(points):
        ends = at + len(window) >= last
        for order in ORDERS:
            rows = ngram_rows(window, order)
            yield rows if ends else rows[:STEP]
        at += STEP


def _count(text: str, label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for part in slices(batches, text):
            for t, lang in zip(part.column(text).to_pylist(), part.column(label).to_pylist(), strict=True):
                mine = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + 1
                for rows in rows_of(code_points(t)):
                    np.add.at(mine, rows, 1)
        for lang, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)),
                 pa.array(np.append(mine[at], docs[lang]))], ["lang", "row", "n"])
    return run


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Fit on every row whose text and label are not null.

    An empty table gives a model without languages, whose predictions are all ``und``.
    What reaches the driver is one count per language and matrix row: at most
    ``MAX_LANGUAGES * (2**BITS + 1)`` rows, whatever the input.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(label).alias("l")).where("t is not null and l is not null")
    counted = (rows.mapInArrow(_count("t", "l"), "lang string, row int, n long")
               .groupBy("lang", "row").agg(F.sum("n").alias("n")))
    packed = (counted.groupBy("lang").agg(F.collect_list(F.struct("row", "n")).alias("c"))
              .orderBy("lang").limit(MAX_LANGUAGES + 1))
    found = packed.toArrow()
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels")
    langs = found.column("lang").to_pylist()
    counts = np.zeros((1 << BITS, len(langs)), dtype=np.float64)
    docs = np.zeros(len(langs))
    lists = found.column("c").combine_chunks()
    for k in range(len(langs)):
        cells = lists[k].values
        at, n = np.asarray(cells.field("row")), np.asarray(cells.field("n"))
        docs[k] = n[at < 0].sum()
        counts[at[at >= 0], k] = n[at >= 0]
    prob = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * (1 << BITS))
    return LanguageModel(langs, np.log(docs / docs.sum()) if len(langs) else docs, prob.astype(np.float32))


def log_likelihood(model: LanguageModel, text: str) -> np.ndarray:
    total = model.log_prior.astype(np.float64)
    for rows in rows_of(code_points(text)):
        used, n = np.unique(rows, return_counts=True) if len(rows) > STEP // 4 else (rows, None)
        picked = model.log_prob[used]
        total = total + (picked.sum(axis=0, dtype=np.float64) if n is None else n @ picked.astype(np.float64))
    return total


def classify(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """Language and posterior probability; ``und`` and 0 without a letter or a model."""
    if text is None or not model.languages or not _LETTER.search(text):
        return UNDETERMINED, 0.0
    score = log_likelihood(model, text)
    best = int(np.argmax(score))  # ties: the language that sorts first
    return model.languages[best], float(1.0 / np.exp(score - score[best]).sum())


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``docs`` with two more columns: the predicted language and its posterior (0 to 1).

    Every row is kept and judged by its whole text alone; repeated rows get equal
    answers.  Null texts and texts without a letter get ``und`` and 0.0.  Columns of
    ``docs`` that are named like the new ones are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))
    keep = [c for c in docs.columns if c not in (pred, score)]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{pred}` string", f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = LanguageModel(*shared.value)
        for part in slices(batches, text):
            found = [classify(held, t) for t in part.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.select(keep).columns, pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], [*keep, pred, score])
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)
