"""Hard-negative mining by coordinate pruning inside length buckets, exact.

Scores are inner products of whole numbers. Rows meet anchors in pieces, a bounded number of anchors and of rows each.
Inside a piece rows stand in buckets by descending length. For a bucket and an anchor, the score that is still of use, over
the anchor's length and the bucket's, bounds the angle between them: beyond a right angle's cosine of 1 the bucket is
skipped, else each of the anchor's largest coordinates (its focus) has a range of values that a row can have there. The
bucket's sorted coordinate lists give the rows in each range, rows in all ranges are candidates, and their scores are
computed exactly. What has been found raises the score that is still of use from bucket to bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.runtime import again, shipped, written

#: Rows of a bucket, and coordinates of an anchor that prune.
BUCKET, FOCUS = 1024, 3
#: Anchors and rows of a piece; rows of a piece while there are fewer than PIECES pieces of them.
PIECE_ANCHORS, PIECE_ROWS, LEAST_ROWS, PIECES = 16384, 16384, 2048, 24
NO_BAND = np.iinfo(np.int64).max


def exact_products(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: by floating point where no sum can leave its 53 bits, else as far as 64 go."""
    largest = lambda v: max(1, int(v.max(initial=0)), -int(v.min(initial=0)))
    bound = q.shape[1] * largest(q) * largest(rows)
    if bound < 1 << 53:
        return (q.astype(float) @ rows.astype(float).T).astype(np.int64)
    if bound < 1 << 63:
        return q @ rows.T
    wide = q.astype(object) @ rows.astype(object).T
    if wide.size and max(abs(wide.max()), abs(wide.min())) >= 1 << 63:
        raise OverflowError("a score leaves 64 bits")
    return wide.astype(np.int64)


class Bucket:
    """Rows of similar length with a list of each coordinate, sorted by value, made when first asked for."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, labels: np.ndarray, lengths: np.ndarray):
        self.ids, self.ints, self.labels, self.longest, self.shortest = ids, ints, labels, lengths.max(), lengths.min()
        self.shares = ints / np.maximum(lengths, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def within(self, coordinate: int, low: float, high: float) -> np.ndarray:
        if coordinate not in self.lists:
            order = np.argsort(self.shares[:, coordinate], kind="stable")
            self.lists[coordinate] = order, self.shares[order, coordinate]
        order, values = self.lists[coordinate]
        return order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")]

    def candidates(self, share: np.ndarray, focus: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows that can have that cosine with the anchor; None: most of them can."""
        reach, hits = np.arccos(cosine), None
        for n, c in enumerate(focus.tolist()):
            angle = np.arccos(min(1.0, max(-1.0, share[c])))
            low, high = np.cos(min(np.pi, angle + reach)), np.cos(max(0.0, angle - reach))
            found = self.within(c, low - 1e-9, high + 1e-9)
            if hits is None:
                hits = np.zeros(len(self.ids), np.int8)
            hits[found] += 1
        kept = np.flatnonzero(hits == len(focus))
        return kept if len(kept) * 2 < len(self.ids) else None


class Best:
    """The first ``k`` (higher score, then smaller id) of one anchor in each of its bands of scores."""

    def __init__(self, low: list[int], high: list[int], k: int):
        self.low, self.high, self.k, self.most = low, high, k, max(high, default=-NO_BAND)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(low)

    def useful(self) -> int:
        """The least score that can still come into any band."""
        return min((max(lo, int(s[-1])) if len(s) == self.k else lo for lo, (s, _) in zip(self.low, self.found)), default=NO_BAND)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        for j, (lo, hi) in enumerate(zip(self.low, self.high)):
            a = np.searchsorted(-scores, -hi, "left")
            b = min(np.searchsorted(-scores, -lo, "right"), a + self.k)
            if b > a:
                s, i = (np.concatenate(x) for x in zip(self.found[j], (scores[a:b], ids[a:b])))
                first = np.lexsort((i, -s))[: self.k]
                self.found[j] = s[first], i[first]


def search(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The first ``k`` rows of a piece in each band of each anchor: anchor (its number), band, score, id.

    ``anchors``: anchor, id, label, ints, low, high (arrays, one entry a band); ``rows``: id, label, ints. Rows have the
    anchor's label (``same``) or another, and another id. Only vectors with as many components meet."""
    out: list[tuple] = []
    sizes = rows["ints"].map(len).to_numpy()
    for d, some in anchors.groupby(anchors["ints"].map(len)):
        own = rows[sizes == d]
        if not len(own):
            continue
        q, x = (np.stack(part["ints"].tolist()).astype(np.int64).reshape(len(part), d) for part in (some, own))
        size, lengths = (np.sqrt((v.astype(float) ** 2).sum(1)) for v in (q, x))
        order = np.argsort(-lengths, kind="stable")
        ids, labels = own["id"].to_numpy(np.int64)[order], own["label"].to_numpy()[order]
        x, lengths = x[order], lengths[order]
        share = q / np.maximum(size, 1e-300)[:, None]
        focus = np.argsort(-np.abs(share), axis=1, kind="stable")[:, :FOCUS]
        best = [Best(list(lo), list(hi), k) for lo, hi in zip(some["low"], some["high"])]
        anchor_ids, anchor_labels = some["id"].to_numpy(np.int64), some["label"].to_numpy()
        for at in range(0, len(x), BUCKET):
            part = slice(at, at + BUCKET)
            bucket = Bucket(ids[part], x[part], labels[part], lengths[part])
            dense = []
            for i, own_best in enumerate(best):
                least = own_best.useful()
                if least == NO_BAND:
                    continue
                over = size[i] * (bucket.longest if least > 0 else bucket.shortest)
                cosine = least / over if over else (-1.0 if least <= 0 else 2.0)
                if cosine > 1 + 1e-9:
                    continue
                cosine = min(1.0, cosine - 1e-9)
                near = None if cosine <= -1 or not len(focus[i]) else bucket.candidates(share[i], focus[i], cosine)
                if near is None:
                    dense.append(i)
                elif len(near):
                    fits = near[((bucket.labels[near] == anchor_labels[i]) == same) & (bucket.ids[near] != anchor_ids[i])]
                    scores = exact_products(q[i : i + 1], bucket.ints[fits])[0]
                    own_best.add(scores[scores >= least], bucket.ids[fits][scores >= least])
            for few in (dense[n : n + BUCKET] for n in range(0, len(dense), BUCKET)):
                for i, scores in zip(few, exact_products(q[few], bucket.ints)):
                    fits = (scores >= best[i].useful()) & (scores <= best[i].most) & ((bucket.labels == anchor_labels[i]) == same) & (bucket.ids != anchor_ids[i])
                    best[i].add(scores[fits], bucket.ids[fits])
        for number, own_best in zip(some["anchor"].tolist(), best):
            for band, (scores, found) in enumerate(own_best.found):
                out += zip([number] * len(found), [band] * len(found), scores.tolist(), found.tolist())
    return pd.DataFrame(out, columns=["anchor", "band", "score", "id"])


def best_rows(anchors: DataFrame, rows: DataFrame, k: int, same: bool, n_anchors: int, n_rows: int) -> DataFrame:
    """anchor, band, score, id and rank (from 1) of the first ``k`` of ``rows`` in each band of each anchor.

    Anchors and rows are dealt into pieces by hash of a row number, and each piece of one meets each piece of the other
    once. A piece has at most about 16384 of either, so rows are copied once for 16384 anchors and anchors once for 16384
    rows, and a task holds two pieces. Only ``k`` rows a band leave it."""
    shipped(rows.sparkSession)
    pieces = max(-(-n_rows // PIECE_ROWS), min(PIECES, -(-n_rows // LEAST_ROWS)), 1)
    blocks = max(-(-n_anchors // PIECE_ANCHORS), 1)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.select("*", dealt("anchor", blocks).alias("block"), every(pieces).alias("piece"))
    right = rows.select("id", "label", "ints", dealt("row", pieces).alias("piece"), every(blocks).alias("block"))

    def meet(key: tuple, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(anchors) or not len(rows):
            return pd.DataFrame({"anchor": [], "band": [], "score": [], "id": []})
        return search(anchors, rows, k, same)

    met = left.groupBy("block", "piece").cogroup(right.groupBy("block", "piece")).applyInPandas(meet, "anchor long, band int, score long, id long")
    w = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(items: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of other labels whose score is ``low`` to
    ``high`` percent of the positive's. Scores are inner products of ``floor(scale * x)``; higher ones come first, ties by
    smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors with other numbers of
    components than the anchor's do not meet it. Other rows are rows with another id; rows that repeat an id are rows of
    their own, as anchors (each with its own result) and as what is found. Equal vectors under many ids are all looked
    at, in pieces dealt by row. An anchor without positives, or a positive without negatives in its band, has no row.
    A score beyond 64 bits is an error. Other columns are ignored whatever their names. An empty table: an empty one."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    whole = F.transform(vector, lambda x: F.floor(scale * x.cast("double")))
    valid = items.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, finite))
    rows = valid.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole.alias("ints"), is_anchor.alias("chosen"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    anchors = rows.filter("chosen").select(F.col("row").alias("anchor"), "id", "label", "ints")
    n_rows, n_anchors = rows.count(), anchors.count()

    # every score counts for a positive: one band without bounds, but for those of a search
    open_band = anchors.withColumns({"low": F.array(F.lit(-NO_BAND)), "high": F.array(F.lit(NO_BAND))})
    best = written(best_rows(open_band, again(rows), positives, True, n_anchors, n_rows), "negatives-positives")

    # in whole numbers; the band of a positive with a negative score is empty
    least, most, banded = F.expr(f"(score * {low} + 99) div 100"), F.expr(f"(score * {high}) div 100"), F.col("score") >= 0
    bands = best.filter(banded).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high")))).alias("bands"))
    bounded = anchors.join(bands, "anchor").select(*anchors.columns, F.col("bands.low").alias("low"), F.col("bands.high").alias("high"))
    found = best_rows(written(bounded, "negatives-bounded"), rows, negatives, False, n_anchors, n_rows)

    positive = best.filter(banded).select("anchor", (F.col("rank") - 1).alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    out = found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positive, ["anchor", "band"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
