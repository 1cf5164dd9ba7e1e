"""Operator 3, quality: co-training of a text classifier and a metadata classifier, for `quality` and for `toxic`.

The text view is the distinct words of the whole text (64-bit hashes, chosen by how well they tell the classes apart) and its shape
(shares of symbols, capitals, digits, repeated words, lengths). The metadata view is source, language and length class. Each view
trains a logistic regression on the labelled rows; for ROUNDS rounds each labels the rows that it is surest of, and both train again
with the other's labels added. All rows of the table take part in that exchange: the features are written once, in a round each row
of which a view is sure is added up in one of GROUPS groups (by label, margin and row), and the sums of a task, some hundred KB, are
added up in a tree. The groups' means, weighted by their rows, stand for the rows in the regressions; together they weigh at most
PSEUDO times as much as the labelled rows, whatever the size of the table. Both views are calibrated (Platt) on held-out labelled
rows and combined by a third regression on their calibrated log-odds, on other held-out rows; equal texts are never split between
the parts. A class of fewer than FEW rows is calibrated and combined by cross-validation instead, and one of a single text on the
training rows. The model then scores every document in one scan.

Training uses at most MAX_LABELLED labelled rows, those of the smallest id hash: the documented bound, which holds what reaches the
driver (features, not texts) to some tens of MB at any size. Labelled rows are those that docs has; each class of each target gets a
quarter of MAX_LABELLED before the rest is filled up, and the log-odds are shifted back to the classes' shares among all labelled
rows. Scoring covers all rows.

Nulls: null text is empty, a null source or language a value of its own, labels that are null are left out. Without labels of both
classes the prior is the answer (quality 1, toxic 0 without any label). Rows that repeat get equal scores. Several labels of one id:
their minimum for quality, maximum for toxic. Very long texts are taken whole. Empty table: no rows. Extra columns pass through
keep_good(); inner names avoid theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, few_files, fresh, lean, read
from .hashing import NON_ALNUM, word_hashes

MAX_LABELLED, MAX_WORDS, ROUNDS = 6000, 1200, 3
FEW, FOLDS, PARTS = 40, 4, 8
SURE, PSEUDO = 0.98, 0.5
MARGINS = (4.5, 6.0, 9.0)  # log-odds that part the rows of one label
GROUPS = 2 * 4 * (len(MARGINS) + 1)
META = 256
_COUNTED = [b"#$%&*|~^!@=+<>{}[]\\_", b"|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?", b" \n\t\r\f\v"]
_CLASSES = np.zeros((len(_COUNTED), 256), np.uint8)
for _i, _c in enumerate(_COUNTED):
    _CLASSES[_i, list(_c)] = 1
SHAPE = len(_COUNTED) + 10
TARGETS = ("quality", "toxic")


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    joined = b"".join(texts.to_pylist())
    sizes = np.array([len(x) for x in texts.to_pylist()], np.int64)
    return np.frombuffer(joined, np.uint8), np.concatenate(([0], np.cumsum(sizes)))


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape of each text (rows x SHAPE), and its distinct words as (row, hash)."""
    raw, offsets = _raw(texts)
    n = len(texts)
    sizes = np.maximum(np.diff(offsets), 1)
    shape = np.zeros((n, SHAPE), np.float32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    for i in range(len(_COUNTED)):
        if len(full):
            shape[full, i] = np.add.reduceat(_CLASSES[i][raw], offsets[full], dtype=np.int64)
    shape[:, : len(_COUNTED)] /= sizes[:, None]
    words, at = word_hashes(texts, NON_ALNUM)
    counts = np.diff(at)
    row = np.repeat(np.arange(n), counts)
    again = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=n) / np.maximum(counts, 1)
    order = np.lexsort((words, row))
    row, words = row[order], words[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    row, words = row[fresh], words[fresh]
    distinct = np.bincount(row, minlength=n)
    k = len(_COUNTED)
    shape[:, k] = np.log1p(counts) / 10
    shape[:, k + 1] = distinct / np.maximum(counts, 1)
    shape[:, k + 2] = sizes / np.maximum(counts, 1) / 10
    shape[:, k + 3] = np.log((counts + 1) / (distinct + 1)) / 3
    shape[:, k + 4] = 4 / (4 + counts)
    shape[:, k + 5] = again
    for j, share in enumerate((shape[:, 0], shape[:, 1], shape[:, 2], again)):
        shape[:, k + 6 + j] = np.log1p(100 * share) / 3
    return shape, row, words


def meta_view(source, lang, n_chars) -> np.ndarray:
    """Columns of the three one-hot features of each row."""
    out = np.zeros((len(source), 3), np.int64)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        out[i] = xxhash.xxh32(f"s{s}").intdigest() % 192, 192 + xxhash.xxh32(f"l{g}").intdigest() % 48, 240 + min(15, int(math.log2(max(1, n or 1))))
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by accelerated gradient descent; the last weight is the bias."""
    bias = np.ones((len(x), x.shape[1] + 1), np.float32)
    bias[:, :-1] = x
    x = bias
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w = z = np.zeros(x.shape[1], np.float32)
    scale = float(np.einsum("ij,ij->i", x, x).max() if len(x) else 1.0) / 4
    rate, total = np.float32(4.0 / max(scale, 1.0)), np.float32(max(weight.sum(), 1.0))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        grad = x.T @ (weight * (p - y)) / total
        grad[:-1] += l2 * z[:-1]
        before, w = w, z - rate * grad
        z = w + np.float32((t - 1) / (t + 2)) * (w - before)
    return w.astype(np.float64)


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = fit(z[:, None] / 4, y, np.ones(len(y)), 300, 1e-4)
    return float(max(a, 0.0)) / 4, float(b)


class Rows:
    """Pseudo-labelled rows as the means of their groups: features, labels, weights."""

    def __init__(self, width: int):
        self.x, self.y, self.rows = np.zeros((0, width), np.float32), np.zeros(0), np.zeros(0)

    @classmethod
    def of(cls, count: np.ndarray, sums: np.ndarray) -> Rows:
        out, full = cls(sums.shape[1]), np.flatnonzero(count)
        out.rows = count[full]
        out.x, out.y = (sums[full] / out.rows[:, None]).astype(np.float32), (full >= GROUPS // 2).astype(float)
        return out

    def weights(self, labelled: int) -> np.ndarray:
        return self.rows * min(1.0, PSEUDO * labelled / max(self.rows.sum(), 1.0))


class Target:
    """One trained label: word weights, shape and metadata weights, calibration, combination."""

    def __init__(self, prior: float):
        self.prior, self.trained = prior, False

    def begin(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, same: np.ndarray, share: float | None = None, seed: int = 1) -> bool:
        """Labelled rows; same: a number for each distinct text; share: of class 1 among all labelled rows, where y is a sample by
        class. False where there is nothing to learn."""
        self.data, self.y, self.share = (text, meta), y, share
        least = min(len(np.unique(same[y == c])) for c in (0, 1))
        if not least:
            return False
        self.folds = 0 if least == 1 else min(FOLDS, least) if least < FEW else 1
        rng = np.random.Generator(np.random.PCG64(seed))
        self.fold = np.zeros(len(y), np.int64)
        for c in (1, 0):  # a text that has both labels goes where its class 0 goes
            texts = rng.permutation(np.unique(same[y == c])).tolist()
            parts = PARTS if self.folds == 1 else max(1, self.folds)
            dealt = {t: i % parts for i, t in enumerate(texts)}
            self.fold = np.array([dealt.get(t, f) for t, f in zip(same.tolist(), self.fold.tolist())], np.int64)
        everything = np.ones(len(y), bool)
        # one eighth for the calibration of the views, one for their combination
        self.platt_rows, self.combine_rows = (self.fold == 0, self.fold == 1) if self.folds == 1 else (everything, everything)
        self.trained = True
        return True

    def fit(self, pseudo: tuple[Rows, Rows]) -> None:
        (self.wt, self.zt), (self.wm, self.zm) = (self._view(x, p) for x, p in zip(self.data, pseudo))
        at = self.platt_rows
        self.ct, self.cm = _platt(self.zt[at], self.y[at]), _platt(self.zm[at], self.y[at])

    def finish(self) -> None:
        at = self.combine_rows
        views = np.stack([self.zt * self.ct[0] + self.ct[1], self.zm * self.cm[0] + self.cm[1]], axis=1)[at]
        self.combine = fit(views / 4, self.y[at], np.ones(at.sum()), 300, 1e-3)
        mean = float(self.y.mean())
        self.shift = 0.0 if self.share is None else math.log(self.share / (1 - self.share)) - math.log(mean / (1 - mean))
        del self.data, self.y, self.fold, self.zt, self.zm, self.platt_rows, self.combine_rows

    def _view(self, x: np.ndarray, pseudo: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Weights, and the log-odds of all rows, of those used for calibration from a fit without their fold."""
        if self.folds == 1:
            w = self._fit(x, self.fold > 1, pseudo)
            return w, odds(x, w)
        w = self._fit(x, np.ones(len(x), bool), pseudo)
        z = odds(x, w)
        for f in range(self.folds):
            z[self.fold == f] = odds(x[self.fold == f], self._fit(x, self.fold != f, pseudo))
        return w, z

    def _fit(self, x: np.ndarray, use: np.ndarray, pseudo: Rows) -> np.ndarray:
        n = int(use.sum())
        return fit(np.vstack([x[use], pseudo.x]), np.concatenate([self.y[use], pseudo.y]), np.concatenate([np.ones(n), pseudo.weights(n)]))

    def score(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities: text view, metadata view, combined."""
        if not self.trained:
            return (np.full(len(zt), self.prior),) * 3
        a, b = zt * self.ct[0] + self.ct[1], zm * self.cm[0] + self.cm[1]
        c = odds(np.stack([a, b], axis=1) / 4, self.combine)
        return tuple(1 / (1 + np.exp(-(x + self.shift))) for x in (a, b, c))


class Model:
    """Chosen words and both targets; small enough to broadcast at any corpus size (MAX_WORDS words)."""

    def __init__(self, words: np.ndarray, targets: dict[str, Target]):
        self.words, self.targets = words, targets
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(words >> np.uint64(44)).astype(np.int64)] = True

    def light(self) -> Model:
        """What a round's exchange needs of the model: no training rows."""
        out = Model(self.words, {})
        for name, t in self.targets.items():
            out.targets[name] = Target(t.prior)
            if t.trained:
                out.targets[name].__dict__.update(trained=True, wt=t.wt, wm=t.wm, ct=t.ct, cm=t.cm)
        return out

    def find(self, row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place among the chosen words) of those that are chosen."""
        near = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        row, words = row[near], words[near]
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        hit = self.words[at] == words if len(self.words) else np.zeros(0, bool)
        return row[hit], at[hit]

    def dense(self, shape, row, words) -> np.ndarray:
        x = np.zeros((len(shape), SHAPE + len(self.words)), np.float32)
        x[:, :SHAPE] = shape
        r, at = self.find(row, words)
        x[r, SHAPE + at] = 1
        return x

    def odds(self, shape: np.ndarray, r: np.ndarray, at: np.ndarray, meta: np.ndarray):
        """(name, target, uncalibrated log-odds of the text view, of the metadata view)."""
        for name, t in self.targets.items():
            zt = zm = np.zeros(len(shape))
            if t.trained:
                zt = shape @ t.wt[:SHAPE] + t.wt[-1] + np.bincount(r, weights=t.wt[SHAPE:-1][at], minlength=len(shape))
                zm = t.wm[:-1][meta].sum(axis=1) + t.wm[-1]
            yield name, t, np.clip(zt, -30, 30), np.clip(zm, -30, 30)

    def score(self, texts: pa.Array, meta: np.ndarray) -> dict[str, np.ndarray]:
        shape, row, words = text_view(texts)
        out = {}
        for name, t, zt, zm in self.odds(shape, *self.find(row, words), meta):
            out[f"p_text_{name}"], out[f"p_meta_{name}"], out[f"p_{name}"] = t.score(zt, zm)
        return out


def _one_hot(meta: np.ndarray) -> np.ndarray:
    x = np.zeros((len(meta), META), np.float32)
    x[np.arange(len(meta))[:, None], meta] = 1
    return x


def _features(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            shape, row, words = text_view(part.column("text"))
            meta = meta_view(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x.tobytes() for x in shape], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary()), pa.array([words[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                names=["doc_id", "shape", "meta", "words"],
            )


def _columns(docs: DataFrame) -> list:
    have = {c.lower() for c in docs.columns}
    return [F.col(c) if c in have else F.lit(None).alias(c) for c in ("source", "lang")] + [F.col("n_chars").cast("long").alias("n_chars") if "n_chars" in have else F.octet_length("text").cast("long").alias("n_chars")]


def _choose(rows: np.ndarray, words: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Words whose presence tells most about y, among those in four texts or more."""
    unique, at, df = np.unique(words, return_inverse=True, return_counts=True)
    pos = np.bincount(at, weights=y[rows], minlength=len(unique))
    n1, n0 = y.sum(), (1 - y).sum()
    a, b = (pos + 0.5) / (n1 + 1), (df - pos + 0.5) / (n0 + 1)
    gain = np.abs(np.log(a / b)) * np.sqrt(np.abs(a - b))
    gain[df < 4] = -1
    best = np.argsort(-gain, kind="stable")[:most]
    return unique[best[gain[best] > 0]]


def _compact(words: np.ndarray):
    """The features of all rows under chosen words: doc_id, shape, meta (3 x int16), places of the words it has (uint16)."""
    model = Model(words, {})

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shape, row, found = text_view(part.column("text"))
                r, place = model.find(row, found)
                ends = np.searchsorted(r, np.arange(part.num_rows + 1))
                meta = meta_view(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars"))).astype(np.int16)
                place = place.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([x.tobytes() for x in shape], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary()), pa.array([place[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())],
                    names=["doc_id", "shape", "meta", "words"],
                )

    return run


def _group(z: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that a view with these calibrated log-odds is sure of, and their groups."""
    sure = np.flatnonzero(np.abs(z) >= math.log(SURE / (1 - SURE)))
    z = z[sure]
    return sure, (z > 0) * (GROUPS // 2) + np.digitize(np.abs(z), MARGINS) * 4 + spread[sure] % 4


def _sums_shape(words: int) -> tuple[int, int]:
    return len(TARGETS), GROUPS * (2 + SHAPE + words + META)


def _exchange(sent, known):
    """The sums of one task: for both targets and each group, rows and summed features for the text view (which learns from the
    metadata view's labels), then the same for the metadata view."""

    def run(batches):
        model = sent.value
        wide = SHAPE + len(model.words)
        sums = {name: (np.zeros(GROUPS), np.zeros((GROUPS, wide)), np.zeros(GROUPS), np.zeros((GROUPS, META))) for name in TARGETS}
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            use = pa.array(~np.isin(ids, known.value) | np.asarray(batch.column("doc_id").is_null()))
            batch = batch.filter(use)
            n = batch.num_rows
            if not n:
                continue
            shape = np.frombuffer(b"".join(batch.column("shape").to_pylist()), np.float32).reshape(n, SHAPE)
            meta = np.frombuffer(b"".join(batch.column("meta").to_pylist()), np.int16).reshape(n, 3).astype(np.int64)
            places = batch.column("words").to_pylist()
            r = np.repeat(np.arange(n), [len(p) // 2 for p in places])
            at = np.frombuffer(b"".join(places), np.uint16).astype(np.int64)
            spread = (shape.view(np.uint32).sum(axis=1, dtype=np.uint64) >> np.uint64(3)).astype(np.int64)
            for name, t, zt, zm in model.odds(shape, r, at, meta):
                if not t.trained:
                    continue
                count_t, sum_t, count_m, sum_m = sums[name]
                which, g = _group(zm * t.cm[0] + t.cm[1], spread)
                count_t += np.bincount(g, minlength=GROUPS)
                of_row = np.full(n, -1)
                of_row[which] = g
                np.add.at(sum_t[:, :SHAPE], g, shape[which])
                hit = of_row[r] >= 0
                sum_t[:, SHAPE:] += np.bincount(of_row[r[hit]] * len(model.words) + at[hit], minlength=GROUPS * len(model.words)).reshape(GROUPS, -1)
                which, g = _group(zt * t.ct[0] + t.ct[1], spread)
                count_m += np.bincount(g, minlength=GROUPS)
                sum_m += np.bincount((g[:, None] * META + meta[which]).ravel(), minlength=GROUPS * META).reshape(GROUPS, META)
        flat = np.stack([np.concatenate([x.ravel() for x in sums[name]]) for name in TARGETS])
        yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["sums"])

    return run


def _add(batches):
    total = None
    for batch in batches:
        for raw in batch.column("sums"):
            x = np.frombuffer(raw.as_buffer(), np.float64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


FAN = 64


def _pseudo_labels(features: DataFrame, model: Model, known: np.ndarray) -> dict[str, tuple[Rows, Rows]]:
    """For each target the rows that each view labels for the other, over all rows of the table; sums are added up FAN tasks at a time,
    and one row reaches the driver."""
    sc = features.sparkSession.sparkContext
    sent, ids = sc.broadcast(model), sc.broadcast(known)
    rows = features.mapInArrow(lean(_exchange(sent, ids)), "sums binary")
    n = len(features.inputFiles())  # one task for each, or fewer
    while n > 1:
        n = math.ceil(n / FAN)
        rows = rows.repartition(n).mapInArrow(lean(_add), "sums binary")
    total = np.zeros(_sums_shape(len(model.words)))
    for r in rows.collect():  # one row, or one for each task of a table of one file
        total += np.frombuffer(r.sums, np.float64).reshape(total.shape)
    sent.destroy()
    ids.destroy()
    wide, out = SHAPE + len(model.words), {}
    for name, flat in zip(TARGETS, total):
        cut = np.cumsum([GROUPS, GROUPS * wide, GROUPS])
        ct, st, cm, sm = np.split(flat, cut)
        out[name] = Rows.of(ct, st.reshape(GROUPS, wide)), Rows.of(cm, sm.reshape(GROUPS, META))
    return out


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Trains on the max_labelled labelled rows of the smallest id hash, a quarter for each class first, and on what each view can
    tell the other about all rows."""
    spark, own = docs.sparkSession, Scratch("quality")
    h = F.xxhash64("doc_id")
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    usable = own.write(known.withColumn("doc_id", F.col("doc_id").cast("long")).join(ids, "doc_id", "left_semi"), "labels")
    classes = ("quality <= 0", "quality > 0", "toxic <= 0", "toxic > 0")
    sizes = usable.agg(*(F.count_if(F.expr(c)).alias(f"c{i}") for i, c in enumerate(classes))).first()
    y_of = {}
    for c, most in [*((c, max_labelled // 4) for c in classes), ("true", max_labelled)]:
        for r in usable.filter(c).orderBy(h, "doc_id").limit(most).collect():
            if c != "true" or len(y_of) < max_labelled:
                y_of[r.doc_id] = (r.quality, r.toxic)
    own.drop("labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_columns(docs))
    wanted = spark.createDataFrame([(i,) for i in y_of], "doc_id long")
    # of rows that share an id, the one of the smallest hash of its text is learnt, so that the driver gets one row an id
    first = F.min(F.struct(F.xxhash64("text").alias("h"), *[F.col(c) for c in rows.columns[1:]])).alias("r")
    sample = rows.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("doc_id", *[f"r.{c}" for c in rows.columns[1:]])
    found = {r.doc_id: r for r in sample.mapInArrow(lean(_features), "doc_id long, shape binary, meta binary, words binary").collect()}
    order = sorted(found)
    shape = np.array([np.frombuffer(found[i].shape, np.float32) for i in order]).reshape(-1, SHAPE)
    meta = np.array([np.frombuffer(found[i].meta, np.int64) for i in order], np.int64).reshape(-1, 3)
    each = [np.frombuffer(found[i].words, np.uint64) for i in order]
    same = np.unique(np.array([xxhash.xxh64_intdigest(found[i].words + found[i].shape) for i in order], np.uint64), return_inverse=True)[1]
    found.clear()
    row, words = np.repeat(np.arange(len(order)), [len(w) for w in each]), np.concatenate(each) if each else np.zeros(0, np.uint64)
    y = np.array([[np.nan if v is None else float(v > 0) for v in y_of[i]] for i in order]).reshape(-1, 2)
    chosen = []
    for k in range(2):
        ok = ~np.isnan(y[:, k])
        use = ok[row]
        chosen.append(_choose(row[use], words[use], np.where(ok, y[:, k], 0), MAX_WORDS // 2) if ok.any() else words[:0])
    targets: dict[str, Target] = {}
    model = Model(np.unique(np.concatenate(chosen)).astype(np.uint64), targets)
    x, one = model.dense(shape, row, words), _one_hot(meta)
    for k, name in enumerate(TARGETS):
        ok = ~np.isnan(y[:, k])
        zeros, ones = sizes[2 * k], sizes[2 * k + 1]
        share = ones / (zeros + ones) if zeros + ones else float(name == "quality")
        targets[name] = Target(share)
        if ok.any():
            targets[name].begin(x[ok], one[ok], y[ok, k], same[ok], share)
    active = [t for t in targets.values() if t.trained]
    if not active:
        return model
    features = own.write(rows.mapInArrow(lean(_compact(model.words)), "doc_id long, shape binary, meta binary, words binary"), "features")
    pseudo = {name: (Rows(x.shape[1]), Rows(META)) for name in TARGETS}
    for r in range(ROUNDS + 1):
        for name, t in targets.items():
            if t.trained:
                t.fit(pseudo[name])
        if r < ROUNDS:
            pseudo = _pseudo_labels(features, model.light(), np.array(order, np.int64))
    for t in active:
        t.finish()
    own.close()
    return model


def _scorer(sent, keep: list[str] | None, names: list[str], least: float, most: float):
    """names: of text, source, language and length."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = sent.value.score(part.column(names[0]), meta_view(*(part.column(c).to_pylist() for c in names[1:])))
                good = (got["p_quality"] >= least) & (got["p_toxic"] <= most)
                if keep is not None:
                    yield part.filter(pa.array(good, pa.bool_())).select(keep)
                else:
                    cols = [part.column("doc_id"), *(pa.array(np.round(v, 6)) for v in got.values()), pa.array(good, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *got, "kept"])

    return run


LEAST_QUALITY, MOST_TOXIC = 0.5, 0.5


def score(docs: DataFrame, model: Model, least: float = LEAST_QUALITY, most: float = MOST_TOXIC) -> DataFrame:
    """Per row: doc_id, the views' and the combined probabilities of both targets, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{v}_{t}" for t in TARGETS for v in ("p_text", "p_meta", "p")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_columns(docs))
    return rows.mapInArrow(lean(_scorer(sent, None, ["text", "source", "lang", "n_chars"], least, most)), "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", kept boolean")


def keep_good(docs: DataFrame, model: Model, least: float = LEAST_QUALITY, most: float = MOST_TOXIC) -> DataFrame:
    """docs without low-quality and toxic documents; all columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["text", *fresh(docs, "source", "lang", "n_chars")]
    names[0] = next(c for c in docs.columns if c.lower() == "text")  # texts go to the workers once
    rows = docs.withColumns(dict(zip(names[1:], _columns(docs))))
    return few_files(rows.mapInArrow(lean(_scorer(sent, docs.columns, names, least, most)), docs.schema))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
