"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics. Its covariance is shrunk towards the pooled covariance and towards a
multiple of the identity. A document's score is the posterior of label 1: the sigmoid of the difference of log prior
minus half the log determinant and half the squared Mahalanobis distance, both from Cholesky factors that are
computed and inverted once. Fitting needs only counts, sums and sums of products, which Spark adds up over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlake.llm.common import bounded_batches, held_out

POOLED, IDENTITY = 0.5, 0.01
#: Bytes that are counted at a time.
CHUNK_BYTES = 500_000

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", b"|", b"#$%&*@~^", b"+=<>/\\_{}[]`", bytes(range(0xC0, 256)), bytes(range(0x80, 0xC0)))
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _POINT, _BANG, _BAR, _SYMBOL, _CODE, _WIDE, _REST, _OTHER = range(13)
_CLASS_OF = np.full(256, _OTHER, np.int64)
for _i, _own in enumerate(_CLASSES):
    _CLASS_OF[list(_own)] = _i
NAMES = ("chars", "words", "word length", "letters", "upper case", "digits", "points", "exclamations", "bars", "symbols", "code marks", "lines", "line length", "distinct words", "distinct lines", "words all upper case", "words that end in a symbol", "accents")


def _counts(raw: list[bytes]) -> np.ndarray:
    """Bytes of each class in each text."""
    out, i = np.zeros((len(raw), 13)), 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) <= CHUNK_BYTES):
            size += len(raw[j])
            j += 1
        doc = np.repeat(np.arange(j - i), [len(x) for x in raw[i:j]])
        kinds = _CLASS_OF[np.frombuffer(b"".join(raw[i:j]), np.uint8)]
        out[i:j] = np.bincount(doc * 13 + kinds, minlength=(j - i) * 13).reshape(-1, 13)
        i = j
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of transformed statistics (NAMES) for each text; finite for any text, null as empty."""
    raw = [(t or "").encode() for t in texts]
    c = _counts(raw)
    chars = c.sum(axis=1) - c[:, _REST]
    words = np.zeros((len(raw), 4))
    lines = np.ones((len(raw), 2))
    marks = b"#$%&*@!~^|"
    for i, t in enumerate(raw):
        own = t.split()
        distinct = set(own)
        words[i] = len(own), len(distinct), sum(w.isupper() for w in own), sum(w[-1] in marks for w in own)
        rows = t.split(b"\n")
        lines[i] = len(rows), len(set(rows))
    letters = c[:, _LOWER] + c[:, _UPPER] + c[:, _WIDE]
    share = lambda x, n: np.log((x + 0.5) / (np.maximum(n - x, 0) + 0.5))  # noqa: E731  a smoothed logit
    rate = lambda x: np.sqrt(x / np.maximum(chars, 1))
    n, distinct, upper, marked = words.T
    return np.column_stack([
        np.log1p(chars), np.log1p(n), np.log1p((chars - c[:, _SPACE] - c[:, _LINE]) / np.maximum(n, 1)), share(letters, chars), rate(c[:, _UPPER]), rate(c[:, _DIGIT]),
        rate(c[:, _POINT]), rate(c[:, _BANG]), rate(c[:, _BAR]), rate(c[:, _SYMBOL]), rate(c[:, _CODE]), np.log1p(lines[:, 0]), np.log1p(chars / lines[:, 0]),
        np.log1p(distinct) / np.log1p(np.maximum(n, 1)), lines[:, 1] / lines[:, 0], np.sqrt(upper / np.maximum(n, 1)), np.sqrt(marked / np.maximum(n, 1)), rate(c[:, _WIDE]),
    ])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(statistics(texts.tolist())), dtype=object)


class Quadratic:
    """Two Gaussians by their Cholesky factors. moments: {label: (n, sums, sums of products)}."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        d = len(NAMES)
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.constant = None
        if not n[0] or not n[1]:
            self.constant = 0.5 if n[0] == n[1] else float(n[1] > 0)
            return
        total = n[0] + n[1]
        mean = {k: moments[k][1] / n[k] for k in n}
        within = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in n}
        pooled = sum(n[k] * within[k] for k in n) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        unit = np.outer(self.scale, self.scale)
        self.mean, self.inverse, self.const = {}, {}, {}
        for k in n:
            cov = (1 - POOLED) * within[k] / unit + POOLED * pooled / unit
            cov = (1 - IDENTITY) * cov + IDENTITY * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(cov + 1e-9 * np.eye(d))
            self.mean[k], self.inverse[k] = mean[k] / self.scale, np.linalg.inv(factor)
            self.const[k] = np.log(n[k] / total) - np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1 for each row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log_density = [self.const[k] - 0.5 * (((x / self.scale - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0], -500, 500)))


def _moments(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """label, at, v: each task's count, sums and sums of products of the statistics of labelled rows that aren't held out."""
    x = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("_id"), _features(F.col(text_col).cast("string")).alias("_x"))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    d = len(NAMES)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for pdf in batches:
            for k, own in sums.items():
                rows = pdf.loc[pdf["_y"] == k, "_x"]
                if len(rows):
                    m = np.stack(rows.tolist())
                    own += np.concatenate(([len(m)], m.sum(axis=0), (m.T @ m).ravel()))
        for k, own in sums.items():
            if own[0]:
                yield pd.DataFrame({"label": k, "at": np.arange(len(own)), "v": own})

    # The merge join shuffles the statistics, so that no task holds a worker for them and another for the moments at once.
    return x.join(known.hint("merge"), "_id").select("_x", "_y").mapInPandas(moments, "label int, at int, v double")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Quadratic:
    """Learns from all rows of labels that aren't held out, joined with docs on the id.

    Labels other than 0 and 1 and null ids are ignored; an id that is repeated on either side counts as often as the
    join makes it. With labels of one class only, every score is that class; with none, 0.5.
    """
    d, parts = len(NAMES), _moments(docs, labels, id_col, text_col, label_col)
    found: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d * d) numbers
        found.setdefault(r["label"], np.zeros(1 + d + d * d))[r["at"]] = r["v"]
    return Quadratic({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in found.items()})


def score(docs: DataFrame, model: Quadratic, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds score_col (0 to 1, higher: label 1 likelier). Null and empty texts are scored like any other, equal texts equally.

    Whole texts are scored. Repeated rows are scored one by one. Other columns pass through, whatever they are called;
    one already named score_col is replaced. An empty table gives an empty result.
    """

    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(statistics(texts.tolist())), dtype="float64")

    return docs.withColumn(score_col, scored(F.col(text_col).cast("string")))
