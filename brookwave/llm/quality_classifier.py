"""Quality classifier: co-training of a content view and a page-metadata view.

- content: hashed frequencies of words, lower-cased and without the signs around them, the share of distinct
  words, that of the commonest one, and the mean length of words
- metadata: source, language and declared length, and the layout of the page: lines, their lengths,
  repeated lines, shares of capitals, digits, blanks and signs. No word counts here, and no layout there

Each view trains a ridge logistic regression on labelled rows. For a number of rounds each then
labels the unlabelled rows it is surest of, out of all of them, and gives them to the other view to train on.
At the end both views are calibrated on labelled rows that they were not trained on, and their
calibrated log-odds are combined by a regression on further such rows; the result scores all documents.

Texts are read once: features of all rows are stored, some 700 bytes each before compression, and the rounds and
the scoring read those. In a round the executors count rows by sureness; the counts give the bound
beyond which the surest rows lie, and only those come to the driver (a few hundred, whatever the size of the table).

Bounded, documented: at most ``labelled_rows`` labelled rows are sampled (by a hash of doc_id) for the
driver's fit. Labels of held-out rows (crc32 of the doc_id as text, modulo 4, is 2) are never read, and no
labelled row is among the unlabelled ones.

Defined results: null and empty texts have zero content features and an empty page's layout; null
metadata counts as a value of its own; rows with an equal doc_id are scored row by row; labels other than
0 and 1 are skipped, of several of a document the largest counts; with labels of one class only, every score is 1 (nothing
is rejected); under 12 rows of a class the calibration uses the rows of the training.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookwave.llm.shared import dropped, read, stored, utf8
from brookwave.llm.toxicity import chosen, held_out, logistic

WORDS, SOURCES, LANGS, LAYOUT = 512, 24, 8, 10
CONTENT, META = WORDS + 3, SOURCES + LANGS + LAYOUT
LABELLED_ROWS = 6_000
ROUNDS, GIVEN, SURE = 3, 200, 0.95
BINS = 16  # of sureness, for each unit of log-odds
THRESHOLD = 0.3
MEMO = 200_000  # words that a worker remembers
SIGNS_AROUND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_memo: dict[bytes, int] = {}


def _place(chunk: bytes) -> int:
    """Where a word counts."""
    return zlib.crc32(chunk.decode("utf-8", "replace").strip(SIGNS_AROUND).lower().encode("utf-8", "replace")) % WORDS


def content(text: str | None) -> np.ndarray:
    """Roots of relative frequencies, and what is said of all words, in 255ths."""
    if len(_memo) > MEMO:
        _memo.clear()
    words = utf8(text).split()
    out = np.zeros(CONTENT)
    if words:
        distinct = Counter(words)
        for w in distinct:
            if w not in _memo:
                _memo[w] = _place(w)
        out[:WORDS] = np.sqrt(np.bincount([_memo[w] for w in distinct], weights=list(distinct.values()), minlength=WORDS) / len(words))
        out[WORDS:] = len(distinct) / len(words), max(distinct.values()) / len(words), min(1.0, sum(map(len, words)) / len(words) / 20)
    return np.round(255 * out).astype(np.uint8)


UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
SIGNS = b"#*$%&|<>!~^=+_@"


def metadata(text: str | None, lang, source, n_chars) -> np.ndarray:
    raw = utf8(text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size, count = max(1, len(raw)), max(1, len(lines))
    share = lambda which: (len(raw) - len(raw.translate(None, which))) / size
    out = np.zeros(META, np.float32)
    out[zlib.crc32(repr(source).encode("utf-8", "replace")) % SOURCES] = 1
    out[SOURCES + zlib.crc32(repr(lang).encode("utf-8", "replace")) % LANGS] = 1
    declared = float(n_chars) if n_chars is not None and n_chars > 0 else 0.0
    out[SOURCES + LANGS :] = [
        math.log1p(len(raw)) / 10, math.log1p(declared) / 10, math.log1p(len(lines)) / 5, math.log1p(len(raw) / count) / 5, 1 - len(set(lines)) / count if lines else 0.0,
        3 * share(UPPER), 3 * share(DIGITS), 5 * share(SIGNS), 3 * raw.count(b" ") / size, float(not lines),
    ]
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1), x.dtype), x])


class View:
    """A regression on one view's features: ``scale`` makes columns alike."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float):
        x = x.astype(np.float64)
        self.scale = 1 / np.maximum(x.std(axis=0), 1e-3)
        self.mean = x.mean(axis=0)
        self.w = logistic(_with_one((x - self.mean) * self.scale), y, ridge)

    def z(self, x: np.ndarray) -> np.ndarray:
        w = self.w[1:] * self.scale
        return x.astype(np.float32) @ w + (self.w[0] - self.mean @ w)


class Model:
    """Two views and what combines their calibrated log-odds; without views all is of quality."""

    def __init__(self, views: tuple | None = None, lines: np.ndarray | None = None, joint: np.ndarray | None = None):
        self.views, self.lines, self.joint = views, lines, joint

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Columns: content, metadata, both."""
        if self.views is None:
            return np.ones((len(a), 3))
        z = np.stack([self.lines[k, 0] + self.lines[k, 1] * np.clip(v.z(x), -12, 12) for k, (v, x) in enumerate(zip(self.views, (a, b), strict=True))], axis=1)
        return np.c_[_sigmoid(z), _sigmoid(_with_one(np.clip(z, -12, 12)) @ self.joint)]


def co_train(a, b, y, surest, rounds: int = ROUNDS, given: int = GIVEN, ridge: tuple[float, float] = (3e-3, 3e-3)) -> Model:
    """a, b: features of labelled rows by view. surest: (views, how many of label 0 and 1, what was given before) -> a, b, view and label of new rows."""
    if len(set(y.tolist())) < 2:
        return Model()
    part = np.full(len(y), -1)  # 0: the lines are fitted on it, 3: what joins them is, others: the views are
    for label in (0, 1):  # of each label alike
        own = np.flatnonzero(y == label)
        part[own] = np.arange(len(own)) % 6
    few = min((y == 0).sum(), (y == 1).sum()) < 12
    train, calibrate, join = (np.ones(len(y), bool),) * 3 if few else (part % 3 != 0, part == 0, part == 3)
    seen = [(a[train], y[train]), (b[train], y[train])]
    views = [View(*seen[k], ridge[k]) for k in (0, 1)]
    share, before = float(y.mean()), set()
    for _ in range(rounds):
        new = surest(views, [max(1, round(given * (1 - share))), max(1, round(given * share))], before)
        if not len(new[3]):
            break
        for k in (0, 1):  # each view gets what the other is sure of
            mine = new[2] == 1 - k
            seen[k] = (np.vstack([seen[k][0], new[k][mine]]), np.r_[seen[k][1], new[3][mine]])
        views = [View(*seen[k], ridge[k]) for k in (0, 1)]
    z = np.clip(np.stack([v.z(x) for v, x in zip(views, (a, b), strict=True)], axis=1), -12, 12)
    lines = np.array([logistic(_with_one(z[calibrate, k : k + 1]), y[calibrate], 1e-3) for k in (0, 1)])
    joint = logistic(_with_one(np.clip(lines[:, 0] + lines[:, 1] * z[join], -12, 12)), y[join], 1e-3)
    return Model(tuple(views), lines, joint)


FEATURES = "doc_id long, a binary, b binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([content(r[0]).tobytes() for r in rows], pa.binary()), pa.array([metadata(*r).tobytes() for r in rows], pa.binary())], names=["doc_id", "a", "b"])


def _matrices(a: list[bytes], b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(a), np.uint8).reshape(len(a), CONTENT), np.frombuffer(b"".join(b), np.float32).reshape(len(b), META)


def _plain(docs: DataFrame) -> DataFrame:
    """The columns read, absent ones as null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def _sureness(views, a: list[bytes], b: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each view: labels, bins of sureness, and which rows it is sure of."""
    floor = math.log(SURE / (1 - SURE))
    for k, (v, x) in enumerate(zip(views, _matrices(a, b), strict=True)):
        z = v.z(x)
        yield k, (z > 0).astype(int), np.minimum(np.abs(z) * BINS, 1_000).astype(int), np.abs(z) > floor


def _row_ids(a: list[bytes], b: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x + y) for x, y in zip(a, b, strict=True)], np.uint64)


def surest_of(pool: DataFrame):
    """The rows of the pool that each view is surest of, found by counts of sureness over all of it."""

    def found(views, most: list[int], before: set):
        def counts(batches):
            n = {}
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                if a:
                    new = ~np.isin(_row_ids(a, b), np.array(sorted(before), np.uint64))
                    for k, label, bin_, sure in _sureness(views, a, b):
                        for key, m in _grouped(label, bin_, sure & new):
                            n[k, *key] = n.get((k, *key), 0) + m
            keys = sorted(n)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in keys], pa.int32()) for i in range(3)] + [pa.array([n[x] for x in keys], pa.int64())], names=["view", "label", "bin", "n"])

        sums = pool.mapInArrow(counts, "view int, label int, bin int, n long").groupBy("view", "label", "bin").agg(F.sum("n").alias("n")).collect()
        share = {}  # of a bin's rows that are wanted
        for k in (0, 1):
            for label in (0, 1):
                left = most[label]
                for r in sorted((r for r in sums if (r.view, r.label) == (k, label)), key=lambda r: -r.bin):
                    share[k, label, r.bin] = min(1.0, (left + 3 * math.sqrt(left) + 10) / r.n)
                    left -= r.n
                    if left <= 0:
                        break

        def wanted(batches):
            for batch in batches:
                a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = []
                if a:
                    ids = _row_ids(a, b)
                    new = ~np.isin(ids, np.array(sorted(before), np.uint64))
                    for k, label, bin_, sure in _sureness(views, a, b):
                        for i in np.flatnonzero(sure & new).tolist():
                            if int(ids[i]) < share.get((k, int(label[i]), int(bin_[i])), 0.0) * (1 << 64):
                                out.append((k, int(label[i]), int(bin_[i]), int(ids[i]) - (1 << 63), a[i], b[i]))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=["view", "label", "bin", "id", "a", "b"])

        # rows with equal features are one row here: what comes is bounded by the wanted ones, even of a large group of copies
        rows = pool.mapInArrow(wanted, "view int, label int, bin int, id long, a binary, b binary").dropDuplicates(["view", "label", "id"]).collect() if share else []
        rows.sort(key=lambda r: (r.view, r.label, -r.bin, r.id))
        taken, count = [], {}
        for r in rows:
            n = count[r.view, r.label] = count.get((r.view, r.label), 0) + 1
            if n <= most[r.label] and r.id + (1 << 63) not in before:
                before.add(r.id + (1 << 63))
                taken.append(r)
        a, b = _matrices([bytes(r.a) for r in taken], [bytes(r.b) for r in taken])
        return a, b, np.array([r.view for r in taken], int), np.array([r.label for r in taken], float)

    return found


def _grouped(label: np.ndarray, bin_: np.ndarray, which: np.ndarray) -> list[tuple[tuple[int, int], int]]:
    keys, n = np.unique(label[which] * 10_000 + bin_[which], return_counts=True)
    return [(divmod(x, 10_000), m) for x, m in zip(keys.tolist(), n.tolist(), strict=True)]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled_rows: int = LABELLED_ROWS) -> tuple[Model, DataFrame]:
    """The model, and the stored features of all rows."""
    features = stored(_plain(docs).mapInArrow(_features, FEATURES), "features")
    all_ids = labels.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held_out("doc_id"))
    y = y.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = labelled_rows / max(1, y.count())
    known = features.join(y.where(chosen(share, "doc_id")), "doc_id").select("y", "a", "b").collect()
    known.sort(key=lambda r: (r.y, bytes(r.a), bytes(r.b)))  # whatever order they came in
    pool = stored(features.join(all_ids, "doc_id", "left_anti").select("a", "b"), "unlabelled")
    a, b = _matrices([bytes(r.a) for r in known], [bytes(r.b) for r in known])
    model = co_train(a, b, np.array([r.y for r in known], float), surest_of(pool))
    dropped(pool)
    return model, features


def _rated(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.scores(*_matrices(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[:, k]) for k in range(3))], names=["doc_id", "content_score", "metadata_score", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: probabilities of quality by either view and by both, and the verdict."""
    model, features = learn(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = features.mapInArrow(_rated(model), "doc_id long, content_score double, metadata_score double, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that reach the threshold, with their columns."""
    model, features = learn(docs, labels)
    dropped(features)
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def good(text, lang, source, n_chars):
        import pandas as pd

        out = []
        for at in range(0, len(text), 512):
            rows = list(zip(*(c.iloc[at : at + 512].astype(object).where(c.iloc[at : at + 512].notna(), None) for c in (text, lang, source, n_chars)), strict=True))
            out.append(model.value.scores(np.array([content(r[0]) for r in rows]), np.array([metadata(*r) for r in rows]))[:, 2] >= threshold)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.where(good(*((F.col(c) if c in docs.columns else F.lit(None)).cast(k) for c, k in kinds.items())))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
