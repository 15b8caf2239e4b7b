"""Language identification with a string kernel, Nyström landmarks and ridge regression.

The kernel is the blended spectrum of orders 1 to 3 on lower-cased text, by presence: two texts
score the number of distinct n-grams that both hold, divided by the geometric mean of their own
numbers. Its feature space is the n-grams of code points that occur in the landmarks (in two of them
at least). One-versus-rest kernel ridge regression is fitted in the span of the landmarks. Every
whole text is scored, a batch of texts by two matrix products: with the landmarks' presence matrix,
then with the regression's coefficients.

The model is fitted on a bounded sample; its bounds are parameters: ``LANGUAGES`` languages, those
with the most texts; of each ``LANDMARKS`` landmarks and ``SAMPLE`` texts, or equal shares of
``ALL_LANDMARKS`` and ``ALL_SAMPLES`` where there are many languages; ``SAMPLE_BYTES`` of text in all;
``COLUMNS`` n-grams, those in the most landmarks. Sampled are the texts with the least hashes of id
and text, below a threshold that counts of distinct texts set, so that no task ranks a language.

Defined cases: a null text, or one without a letter, gets ``und`` and score 0, as does every
text when nothing could be learned. A null doc_id is never learned from and never held out. Rows
that share id, text and lang are learned from once. A tie goes to the language that sorts first.
Repeated rows give repeated results. Texts are worked on in runs of about 2 MB, a longer one alone,
in memory that is in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, sliced, strings

LANGUAGES = 64
LANDMARKS, ALL_LANDMARKS = 48, 512
SAMPLE, ALL_SAMPLES = 300, 6400
SAMPLE_BYTES = 64 << 20
COLUMNS = 1 << 16
RIDGE = 1e-3
#: How many times the sample is expected below the threshold.
SPARE = 4
#: Numbers of n-grams up to which their columns are found in a table of all of them.
TABLE = 1 << 22
ORDERS = (1, 2, 3)


def bucket(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts, each followed by a zero, starts of the texts and the end)."""
    texts = [t.lower().replace("\0", " ") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32), starts


class Grams:
    """The column of each n-gram of one order: in a table of all numbers where that is small, else by search."""

    def __init__(self, codes: np.ndarray, columns: np.ndarray, numbers: int):
        self.codes, self.columns, self.table = codes, columns, None
        if numbers <= TABLE:
            self.table = np.full(numbers, -1, np.int32)
            self.table[codes] = columns

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Columns of n-grams, -1 for those without."""
        if self.table is not None:
            return self.table[grams]
        if not len(self.codes):
            return np.full(len(grams), -1, np.int32)
        at = np.minimum(np.searchsorted(self.codes, grams), len(self.codes) - 1)
        return np.where(self.codes[at] == grams, self.columns[at], -1)


def numbered(kind: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order the number of the n-gram that starts at each place, of letters numbered below ``size``."""
    gram = kind if size ** max(ORDERS) <= TABLE else kind.astype(np.int64)
    for n in ORDERS:
        if n > 1:
            gram = gram[:-1] * size + kind[n - 1 :]
        yield n, gram


@dataclass
class Model:
    langs: list[str]
    letters: np.ndarray  # number of each code point from 1 on; 0 for those that no landmark has, and between texts
    slots: list[Grams]  # by order
    landmarks: np.ndarray  # presence by landmark and column
    norms: np.ndarray
    alpha: np.ndarray  # by landmark and language

    def presence(self, texts: list[str]) -> np.ndarray:
        """Presence by text and column, in 32-bit floats for the matrix product."""
        codes, starts = joined(texts)
        x = np.zeros((len(texts), self.landmarks.shape[1]), np.float32)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
        for (_, gram), slots in zip(numbered(self.letters[codes], int(self.letters.max()) + 1), self.slots):
            column = slots.find(gram)  # an n-gram with a letter 0 has none
            at = np.flatnonzero(column >= 0)
            x[row[at], column[at]] = 1
        return x

    def kernel(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        own = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return (x @ self.landmarks.T) / (own[:, None] * self.norms[None, :])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for k in range(0, len(texts), 256):
            f = self.kernel(texts[k : k + 256]) @ self.alpha
            best = f.argmax(axis=1)
            names += [self.langs[i] for i in best]
            scores.append(np.clip(f[np.arange(len(best)), best], 0, 1))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(texts: list[str], langs: list[str], landmark: list[bool]) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    chosen = [t for t, is_one in zip(texts, landmark, strict=True) if is_one]
    own = [joined([t])[0] for t in chosen]
    values = np.unique(np.concatenate(own))
    letters = np.zeros(0x110000, np.int32)
    letters[values[values > 0]] = np.arange(1, (values > 0).sum() + 1)
    size, found = int(letters.max()) + 1, {n: [] for n in ORDERS}
    for codes in own:
        kind = letters[codes]
        for n, gram in numbered(kind, size):
            whole = np.lib.stride_tricks.sliding_window_view(kind > 0, n).all(axis=1) if len(kind) >= n else np.zeros(0, bool)
            found[n].append(np.unique(gram[whole]))
    counted = {n: np.unique(np.concatenate(x), return_counts=True) for n, x in found.items()}
    every = np.concatenate([counts for _, counts in counted.values()])
    wanted = every >= min(2, len(chosen))
    wanted[np.argsort(-every, kind="stable")[COLUMNS:]] = False
    columns, slots, at = np.cumsum(wanted) - 1, [], 0
    for n in ORDERS:
        codes, kept = counted[n][0], wanted[at : at + len(counted[n][0])]
        slots.append(Grams(codes[kept].astype(np.int64), columns[at : at + len(codes)][kept].astype(np.int32), size**n))
        at += len(codes)
    model = Model(names, letters, slots, np.zeros((1, int(wanted.sum())), np.float32), np.ones(1, np.float32), np.zeros((1, len(names))))
    marks = model.presence(chosen)
    model.landmarks, model.norms = marks, np.sqrt(np.maximum(marks.sum(axis=1), 1))
    k_nm = np.concatenate([model.kernel(texts[k : k + 256]) for k in range(0, len(texts), 256)]).astype(np.float64)
    k_mm = model.kernel(chosen).astype(np.float64)
    y = np.array([[float(lang == name) for name in names] for lang in langs])
    weight = 1 / y.sum(axis=0)[[names.index(x) for x in langs]]  # languages weigh the same
    a = k_nm.T @ (weight[:, None] * k_nm) + RIDGE * len(names) * k_mm + 1e-8 * np.eye(len(k_mm))
    model.alpha = np.linalg.solve(a, k_nm.T @ (weight[:, None] * y)).astype(np.float32)
    return model


def _known(docs: DataFrame) -> DataFrame:
    """lang, h (63 bits of a hash of id and text) and text of the rows to learn from."""
    rows = docs.where(F.col("lang").isNotNull() & (bucket("doc_id") != 2) & F.col("text").isNotNull())
    return rows.select("lang", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h"), "text")


def choose(found: list[tuple[str, int, int]], sample: int, landmarks: int, limit: int) -> list[tuple[str, int, bool]]:
    """(lang, h, landmark) of the rows to learn from, of candidates (lang, h, bytes).

    Each language's least hashes, one of every language in turn, as far as ``limit`` bytes go.
    """
    ranked, by = [], {}
    for lang, h, size in sorted(found):
        by[lang] = by.get(lang, 0) + 1
        ranked.append((by[lang], lang, h, size))
    out, taken = [], {}
    for _, lang, h, size in sorted(ranked):
        if taken.get(lang, 0) < sample and size <= limit:
            limit -= size
            taken[lang] = taken.get(lang, 0) + 1
            out.append((lang, h, taken[lang] <= landmarks))
    return out


def training_rows(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, languages: int = LANGUAGES, limit: int = SAMPLE_BYTES) -> list:
    """lang, h, landmark, text of the sample, as rows on the driver."""
    spark, known = docs.sparkSession, _known(docs)
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count(F.lit(1)).alias("rows"))
    counts = counts.orderBy(F.desc("rows"), "lang").limit(languages).collect()
    if not counts:
        return []
    sample, landmarks = min(sample, ALL_SAMPLES // len(counts)), min(landmarks, ALL_LANDMARKS // len(counts))
    # Of a language's distinct hashes some SPARE * sample are below its threshold, whatever their number.
    below = [(r["lang"], min((1 << 63) - 1, (1 << 63) * SPARE * (sample + 16) // max(1, r["n"]))) for r in counts]
    below = F.broadcast(spark.createDataFrame(below, "lang string, below long"))  # LANGUAGES rows
    found = known.join(below, "lang").where("h <= below").groupBy("lang", "h").agg(F.min(F.octet_length("text")).alias("size")).collect()
    picked = choose([tuple(r) for r in found], sample, landmarks, limit)
    chosen = F.broadcast(spark.createDataFrame(picked, "lang string, h long, landmark boolean"))  # ALL_SAMPLES rows at most
    rows = known.join(chosen, ["lang", "h"]).groupBy("lang", "h", "landmark").agg(F.min("text").alias("text"))
    return sorted(rows.collect(), key=lambda r: (r.lang, r.h))


def train(docs: DataFrame, **bounds) -> Model | None:
    rows = training_rows(docs, **bounds)
    return fit([r.text for r in rows], [r.lang for r in rows], [r.landmark for r in rows])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ALL_LANDMARKS times COLUMNS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                letters = np.array(part.column(3).to_pylist(), bool)
                names, scores = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if shared.value is not None and letters.any():
                    texts = strings(part.column(2).filter(pa.array(letters)))
                    got, by = shared.value.predict(texts)
                    names[letters], scores[letters] = got, by
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(bucket(id_col) == 2, F.lit(False)).alias("held_out"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return arrow_map(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
