"""Toxicity scores of a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams of the lower-cased text, hashed to 2^20 places.
For each place the log ratio of its smoothed counts in toxic and clean training texts is taken;
a logistic regression is then fitted on the features scaled by their ratios, so that a score is
``sigmoid(b + sum of w * r over the text's features)``.

The model is fitted on at most ``SAMPLE`` labelled documents of each class, those with the smallest
hashes of their ids, and has at most ``FEATURES`` places, those that tell the classes apart most:
these are its two parameters. Tasks count the places of all training texts; the driver gets their
counts, chooses the places, and then gets each text's chosen ones. Every whole text is scored.

Defined cases: a null or empty text has no features and gets the score of the intercept. A row
whose doc_id is null is never used in training and is not held out. Labels that are null are
not used; of several labels of a document the larger counts, of several texts of one doc_id the one
that sorts first is learned from. Without rows of both classes every score is that of the only class,
or 0. Repeated rows give repeated results; other columns are ignored, or kept by ``keep_clean``. Texts are
worked on in runs of about 2 MB, a longer one alone, in memory that is in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedTable, arrow_map, sliced, strings, whole_text

#: Orders of the n-grams.
ORDERS = (4, 5, 6)
BITS = 20
#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 1500
#: Features kept: those that tell the classes apart most.
FEATURES = 6000
#: Tasks that count the training texts; the driver gets two numbers for each place from each.
PARTS = 8


def bucket(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts one after another, ends of the texts)."""
    texts = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def hashed_grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the place of the n-gram that starts at each code point; the last ones are cut short."""
    h = codes * np.uint32(0x9E3779B1)
    for n in range(2, max(ORDERS) + 1):
        h = (h[: max(0, len(codes) - n + 1)] * np.uint32(0x85EBCA6B)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n))
        if n in ORDERS:
            yield n, ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)


def features(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of each distinct feature of each text, of the wanted places only."""
    codes, ends = code_points(texts)
    found = []
    for n, places in hashed_grams(codes):
        at = np.flatnonzero(wanted[places]) if wanted is not None else np.arange(len(places))
        doc = np.searchsorted(ends, at, "right")
        inside = at + n <= ends[doc] if len(at) else np.zeros(0, bool)
        found.append((doc[inside] << BITS) | places[at[inside]].astype(np.int64))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    places: np.ndarray  # of the features, ascending
    weights: np.ndarray  # regression weight times log-count ratio
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.places):
            return np.full(len(texts), float(self.intercept > 0))
        wanted = self.wanted()
        doc, place = features(texts, wanted)
        sums = np.bincount(doc, self.weights[np.searchsorted(self.places, place)], len(texts))
        return _sigmoid(self.intercept + sums)

    def wanted(self) -> np.ndarray:
        if not hasattr(self, "_wanted"):
            self._wanted = np.zeros(1 << BITS, bool)
            self._wanted[self.places] = True
        return self._wanted


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def chosen_places(p: np.ndarray, q: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, log-count ratios) of the features to keep, from counts in n1 toxic and n0 clean texts."""
    ratio = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
    # How far the share among toxic texts is from the share among clean ones, in standard errors.
    share = (p + q + 1) / (n1 + n0 + 2)
    apart = np.abs(p / n1 - q / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    apart[p + q < 5] = 0
    places = np.sort(np.argsort(-apart, kind="stable")[:FEATURES])
    places = places[apart[places] > 2]
    return places, ratio[places]


def only_class(n1: int, n0: int) -> Model:
    """The model where one class, or both, are missing."""
    return Model(np.zeros(0, np.int64), np.zeros(0), np.inf if n1 and not n0 else -np.inf)


def fit_chosen(rows: list[np.ndarray], labels: np.ndarray, places: np.ndarray, ratio: np.ndarray, penalty: float = 1.0, steps: int = 150) -> Model:
    """Fit on the chosen places (their numbers) of each training text."""
    x = np.zeros((len(rows), len(places)), np.float32)
    for i, row in enumerate(rows):
        x[i, row] = 1
    x *= ratio.astype(np.float32)
    w, b = _logistic(x, labels.astype(np.float32), penalty, steps)
    return Model(places, w * ratio, b)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-penalised regression, by accelerated gradient steps; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if 0 < y.mean() < 1 else np.ones_like(y)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * weight.max() * (top + len(y)) + penalty)
    w, b, w0, b0 = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for k in range(steps):
        m = k / (k + 3)
        u, c = w + m * (w - w0), b + m * (b - b0)
        g = weight * (_sigmoid(x @ u + c) - y)
        w0, b0, w, b = w, b, (u - step * (x.T @ g + penalty * u)).astype(np.float32), c - step * float(g.sum())
    return w.astype(np.float64), float(b)


def training_ids(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label: the sample of each class, from rows that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(bucket("doc_id", 5) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("label"))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label, text: a row for each id of training_ids() that has a document, 2 * sample at most."""
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(training_ids(labels, sample)), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on the sample."""
    rows = SharedTable(training_rows(docs, labels, sample).repartition(PARTS), "toxicity-training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << BITS), np.uint16), [0, 0]  # 2 * sample stays below 65,536
        for batch in batches:
            for part in sliced(batch, "text"):
                label = part.column(1).to_numpy().astype(bool).astype(np.int64)
                doc, place = features(strings(part.column(2)))
                np.add.at(counts, (label[doc], place), 1)
                n = [n[0] + int((label == 0).sum()), n[1] + int((label == 1).sum())]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n] + [pa.array([pa.compress(counts, "zstd", asbytes=True)], pa.binary())], names=["n0", "n1", "counts"])

    assert 2 * sample < 1 << 16
    parts = arrow_map(rows.df, count, "n0 long, n1 long, counts binary").collect()
    n0, n1 = sum(r.n0 for r in parts), sum(r.n1 for r in parts)
    if not n0 or not n1:
        rows.drop()
        return only_class(n1, n0)
    q, p = sum(np.frombuffer(pa.decompress(r.counts, 4 << BITS, "zstd"), np.uint16).reshape(2, -1).astype(np.float64) for r in parts)
    places, ratio = chosen_places(p, q, n1, n0)
    wanted = np.zeros(1 << BITS, bool)
    wanted[places] = True
    shared = docs.sparkSession.sparkContext.broadcast((wanted, places))  # 1 MB and FEATURES numbers

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, places = shared.value
        for batch in batches:
            for part in sliced(batch, "text"):
                doc, place = features(strings(part.column(2)), wanted)
                bounds = np.searchsorted(doc, np.arange(part.num_rows + 1))
                at = np.searchsorted(places, place).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), pa.array([at[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["doc_id", "label", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = arrow_map(rows.df, cut, f"doc_id {kind}, label int, places binary").toArrow().sort_by([("doc_id", "ascending")])
    rows.drop()
    assert got.num_rows <= 2 * sample
    column = got.column("places")
    return fit_chosen([np.frombuffer(column[i].as_buffer(), np.uint16) for i in range(got.num_rows)], got.column("label").to_numpy(), places, ratio)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES places and weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                scores = shared.value.scores(strings(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(bucket(id_col, 5) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns, on the map side."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                yield part.filter(pa.array(shared.value.scores(strings(part.column(at))) < threshold))

    return arrow_map(docs, run, docs.schema)
