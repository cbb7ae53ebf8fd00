"""Compression classifier: two zstandard dictionaries, from good and from bad labelled text. A text's score is the
difference of its compressed sizes with both, over its length, turned into a probability; nothing else goes in.

The calibration is fitted on differences that come from dictionaries without the text itself: the sample is cut into
folds, and each fold is measured with dictionaries of the others. The dictionaries of the model hold the whole sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the labelled sample that the dictionaries and the calibration are fitted on: rows of a class, characters
#: of a text that may be in it. Texts of the sample are whole.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
#: Bytes of a dictionary (text as it is, in pieces from all over the sample), bytes of a piece, compression level, folds
#: of the calibration, and the bytes added to a length, so that a few bytes decide little in short texts.
DICT_BYTES, PIECE, LEVEL, FOLDS, NORM = 1_000_000, 1000, 9, 4, 100


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    offset: float
    slope: float
    prior: float
    level: int = LEVEL

    def difference(self) -> Callable[[str | None], float]:
        """The function that gives a whole text's normalised difference: how many bytes it takes more with the bad
        dictionary than with the good one, over its bytes and NORM; 0 for empty texts."""
        import zstandard as z

        data = [z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT) for d in (self.good, self.bad)]
        good, bad = (z.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False) for d in data)

        def of(text: str | None) -> float:
            raw = (text or "").encode()
            return (len(bad.compress(raw)) - len(good.compress(raw))) / (len(raw) + NORM) if raw else 0.0

        return of

    def probability(self, difference: np.ndarray, empty: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.offset + self.slope * difference, -30, 30)))
        return np.where(empty, self.prior, p)


def dictionary(texts: list[str], size: int = DICT_BYTES, piece: int = PIECE) -> bytes:
    """Pieces of all texts, evenly spread over them, up to ``size`` bytes."""
    parts = [raw[k : k + piece] for t in texts for raw in [t.encode()] for k in range(0, len(raw), piece)]
    step = max(1.0, sum(map(len, parts)) / size)
    return b"\n".join(parts[int(k * step)] for k in range(int(len(parts) / step)))[:size].ljust(8, b"\n")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", exclude: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled rows of each class, chosen by a hash of the id, texts of at most
    ``sample_chars`` characters; the calibration is weighted to the classes' share among all usable labels. Rows with null labels, ids or texts, and rows of
    ``exclude``, are not used; a row labelled twice counts once, with its larger label. Without rows of both classes
    every score is the share of label 1 (0.5 without labels). Other columns are ignored."""
    exclude = F.lit(False) if exclude is None else exclude
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1)).groupBy(id_col).agg(F.max("_y").alias("_y"))
    known = known.filter(~exclude)
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (share.get(1, 0) / sum(share.values())) if share else 0.5
    order = F.xxhash64(F.col(id_col), F.lit(17))
    # a bounded candidate list of ids first, so that the texts are read by a broadcast join, not shuffled
    some = [known.filter(F.col("_y") == y).orderBy(order, id_col).limit(2 * sample_rows) for y in (0, 1)]
    picked = some[0].unionByName(some[1])
    texts = docs.filter(F.col(text_col).isNotNull() & (F.length(text_col) <= sample_chars)).select(id_col, text_col)
    rows = texts.join(F.broadcast(picked), id_col).select(F.col(text_col).alias("t"), "_y", order.alias("h"), F.col(id_col).alias("i")).dropDuplicates(["i"])
    got = rows.toPandas().sort_values(["h", "i"], kind="stable")
    sides = [got[got["_y"] == y].head(sample_rows)["t"].tolist() for y in (0, 1)]
    if min(map(len, sides)) < FOLDS:
        return QualityModel(b"\n" * 8, b"\n" * 8, float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), 0.0, prior)
    x, y = [], []
    for fold in range(FOLDS):
        bad, good = (dictionary([t for k, t in enumerate(side) if k % FOLDS != fold]) for side in sides)
        of = QualityModel(good, bad, 0.0, 0.0, prior).difference()
        for label, side in enumerate(sides):
            x += [of(t) for t in side[fold::FOLDS]]
            y += [float(label)] * len(side[fold::FOLDS])
    x, y = np.array(x), np.array(y)
    weight = np.where(y > 0, prior / len(sides[1]), (1 - prior) / len(sides[0])) * len(y)
    scale = x.std() or 1.0
    offset, slope = weighted_logistic(np.column_stack([np.ones_like(x), x / scale]), y, weight)
    return QualityModel(dictionary(sides[1]), dictionary(sides[0]), float(offset), float(slope / scale), prior)


def weighted_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the calibrated probability of label 1, from whole texts, also very long ones, one at a
    time. Empty and null texts get the share of label 1; equal texts get equal scores. A column ``out_col`` of the input
    gives way, all others stay. An empty table gives an empty table. The model that goes to the workers is two
    dictionaries of bounded size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = sent.value.difference()
        for x in parts:
            yield pd.Series(sent.value.probability(np.array([of(t) for t in x], float), np.array([not t for t in x], bool)))

    return docs.withColumn(out_col, score(F.col(text_col)))
