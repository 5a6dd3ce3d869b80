"""Operators 3 and 6: quality scores learned from labelled rows.

Operator 6, quality rules: count rules fail texts outright; the others get a logistic regression on hashed
word and character n-grams, trained on labelled rows, its scores calibrated (Platt) on rows that the
training left aside, and are kept at a fixed threshold.

Operator 3, positive-unlabelled learning: trusted positives (quality 1) against unlabelled text. The
non-negative risk  pi R+(+) + max(0, R_u(-) - pi R+(-))  is minimised with the logistic loss, where the
class prior pi is estimated with a first classifier of positives against unlabelled text: the share of
unseen unlabelled rows above the score that 95 % of unseen positives reach, divided by that 95 %.

Labelled rows are a bounded sample (SAMPLE of each kind, those of the smallest hashed ids), the only thing
bounded here. Operator 6 is fitted on them alone, on the driver. Operator 3 starts there with a sample of
unlabelled texts; its prior's shares and its risk are then sums over all unlabelled training texts, whose
features are stored packed, and the risk is descended on those. Scoring reads whole texts in Arrow batches,
and the weights, some 8 KB, travel with the task.

Defined cases: null or empty text has zero counts and still a score; very long texts are one text each, read
in runs; of labels that repeat for a doc_id the lower one counts, once; of texts that repeat a doc_id the least
is the labelled one; null or unknown labels are left out; one row of a kind is enough, without labels of both
kinds (operator 3: without positives) the score is 1/2 everywhere; with fewer than five rows of each kind the
calibration has no rows and the margin counts as it is; empty tables give empty results; label, lang, source
and doc_id are never inputs of a score; of clashing names the first counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base
from .features import _SYMBOL, DENSE, DIMENSIONS, chunks

#: Labelled rows of each kind that a model is fitted on; operator 3 starts from twice as many unlabelled ones.
SAMPLE = 3000
#: Operator 3's descents over all unlabelled texts, and what is added to the sample's curvature for them.
STEPS, DAMPING = 5, 0.02
#: Fixed thresholds on the calibrated probability of good quality.
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


@dataclass
class Linear:
    """A logistic model of standardised features, then a calibration of its margin."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.float32) - self.center) / self.scale) @ self.weights + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margin(x) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _standardised(*parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The parts in one scale, as float32 in place of one copy, and the scale: the driver holds little else."""
    z = np.concatenate(parts).astype(np.float32)
    center, spread = z.mean(0), np.maximum(z.std(0), np.float32(1e-3))
    if spread[DENSE:].size:
        spread[DENSE:] = max(float(np.sqrt((spread[DENSE:] ** 2).mean())), 1e-3)  # one scale for hashed counts: rare ones stay small
    scale = spread * np.sqrt(np.where(np.arange(len(spread)) < DENSE, 1.0, 8.0)).astype(np.float32)
    z -= center
    z /= scale
    return np.split(z, np.cumsum([len(p) for p in parts])[:-1]), center, scale


def _adam(gradient, size: int, steps: int = 400, rate: float = 0.03) -> np.ndarray:
    at, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(at)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return at


def fit_logistic(x: np.ndarray, y: np.ndarray, decay: float = 2e-3) -> Linear:
    (z,), center, scale = _standardised(x)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))

    def gradient(p: np.ndarray) -> np.ndarray:
        e = ((sigmoid(z @ p[:-1].astype(np.float32) + p[-1]) - y) * weight).astype(np.float32)
        return np.append(z.T @ e + decay * p[:-1], e.sum())

    p = _adam(gradient, x.shape[1] + 1)
    return Linear(center, scale, p[:-1], float(p[-1]))


def calibrate(model: Linear, x: np.ndarray, y: np.ndarray) -> Linear:
    """Platt scaling on rows that the fit has not seen."""
    if len(y) and 0 < y.sum() < len(y):
        margin = model.margin(x)
        a, b = _adam(lambda p: np.array([((sigmoid(p[0] * margin + p[1]) - y) * margin).mean(), (sigmoid(p[0] * margin + p[1]) - y).mean()]), 2, 600, 0.05)
        if a > 0:
            model.slope, model.shift = float(a), float(b)
    return model


def _half(x: np.ndarray, fold: int) -> np.ndarray:
    return x[fold::2] if len(x) > 1 else x


def discriminators(positive: np.ndarray, unlabelled: tuple[np.ndarray, np.ndarray]) -> list[tuple[Linear, float, float]]:
    """For each fold (model, bar, share): a classifier of its positives against its unlabelled rows, the score
    that 95 % of the other positives reach, and the share that does."""
    out = []
    for fold in (0, 1):
        fit_p, fit_u = _half(positive, fold), unlabelled[fold]
        model = fit_logistic(np.concatenate([fit_p, fit_u]), np.repeat([1.0, 0.0], [len(fit_p), len(fit_u)]))
        seen = model.score(_half(positive, 1 - fold))
        # the score at which most positives lie: below it, unlabelled text is in excess
        bar = float(np.quantile(seen, 0.05))
        out.append((model, bar, max(float((seen >= bar).mean()), 1e-6)))
    return out


def prior_of(found: list[tuple[Linear, float, float]], reached: list[float]) -> float:
    """The class prior from the shares of unseen unlabelled rows that reach each fold's bar."""
    return float(np.clip(np.mean([r / share for r, (_, _, share) in zip(reached, found, strict=True)]), 0.05, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from two folds of a positive-against-unlabelled classifier."""
    folds = _half(unlabelled, 0), _half(unlabelled, 1)
    found = discriminators(positive, folds)
    return prior_of(found, [float((model.score(folds[1 - k]) >= bar).mean()) for k, (model, bar, _) in enumerate(found)])


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, decay: float = 2e-3) -> Linear:
    """Minimises the non-negative risk; where the negative part falls below zero its gradient is turned back."""
    (p, u), center, scale = _standardised(positive, unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        v = w[:-1].astype(np.float32)
        sp, su = sigmoid(p @ v + w[-1]), sigmoid(u @ v + w[-1])
        loss_u, loss_p = -np.log(np.maximum(1 - su, 1e-12)).mean(), -np.log(np.maximum(1 - sp, 1e-12)).mean()
        e_pos = prior * (sp - 1) / len(p)
        e_neg_p, e_neg_u = -prior * sp / len(p), su / len(u)
        if loss_u - prior * loss_p < 0:
            e_pos, e_neg_p, e_neg_u = np.zeros(len(p)), -e_neg_p, -e_neg_u
        e_p = e_pos + e_neg_p
        return np.append(p.T @ e_p.astype(np.float32) + u.T @ e_neg_u.astype(np.float32) + decay * w[:-1], e_p.sum() + e_neg_u.sum())

    w = _adam(gradient, positive.shape[1] + 1, 500)
    return Linear(center, scale, w[:-1], float(w[-1]))


def sampled_features(docs: DataFrame, ids: DataFrame, rows: int) -> dict[str, np.ndarray]:
    """Features of the documents of at most ``rows`` sampled ids (doc_id, kind), gathered by kind; of rows that repeat an id the least text."""
    chosen = base.cut(ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(rows))
    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    plain = plain.groupBy("doc_id", "kind").agg(F.min("text").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, chunk in chunks(batch.column("text")):
            x = chunk.features().astype(np.float16)
            part = batch.slice(first, chunk.texts)
            yield pa.RecordBatch.from_arrays([part.column("kind"), part.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["kind", "doc_id", "x"])

    got = base.arrow_map(plain.select("doc_id", "text", "kind"), run, "kind string, doc_id long, x binary").toArrow()
    kinds, order = got.column("kind").to_pylist(), np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    out: dict[str, list] = {}
    values = got.column("x").to_pylist()
    for k in order.tolist():
        out.setdefault(kinds[k], []).append(np.frombuffer(values[k], np.float16))
    return {k: np.stack(v) for k, v in out.items()}


def labelled(labels: DataFrame, training: Column | None) -> DataFrame:
    """(doc_id, kind) of usable labels, one for each id: kind is the quality as text."""
    rows = base.take(labels, "doc_id", "quality").select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    rows = rows.where(training) if training is not None else rows
    return rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).select("doc_id", F.col("quality").cast("string").alias("kind"))


def _merged(*parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v for p in parts for k, v in p.items()}


def neutral() -> Linear:
    size = DENSE + DIMENSIONS
    return Linear(np.zeros(size), np.ones(size), np.zeros(size))


def train_quality(docs: DataFrame, labels: DataFrame, training: Column | None = None, rows: int = SAMPLE) -> Linear:
    """Operator 6's model: both kinds of labels, every fifth row left aside for calibration."""
    known = base.cut(labelled(labels, training))
    x = _merged(*(sampled_features(docs, known.where(F.col("kind") == k), rows) for k in ("0", "1")))
    if len(x) < 2:
        return neutral()
    fit, held = ({k: v[np.arange(len(v)) % 5 != 4] for k, v in x.items()}, {k: v[4::5] for k, v in x.items()})
    both = lambda s: (np.concatenate([s["0"], s["1"]]), np.repeat([0.0, 1.0], [len(s["0"]), len(s["1"])]))
    return calibrate(fit_logistic(*both(fit)), *both(held))


def packed_features(docs: DataFrame, training: Column) -> DataFrame:
    """(n, folds, dense, top, hashed): the features of all unlabelled training texts, some 500 a row; hashed ones in
    255ths of a text's largest. About a third of the text's size."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int").alias("fold")
    plain = base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").where(training).select("text", fold)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        folds = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for first, chunk in chunks(batch.column(0)):
            x = chunk.features()
            top = np.maximum(x[:, DENSE:].max(1), 1e-9).astype("<f4")
            hashed = np.rint(x[:, DENSE:] * (255 / top)[:, None]).astype(np.uint8)
            row = (folds[first : first + chunk.texts].tobytes(), x[:, :DENSE].astype("<f4").tobytes(), top.tobytes(), zlib.compress(hashed.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array([chunk.texts], pa.int32()), *[pa.array([v], pa.binary()) for v in row]], ["n", "folds", "dense", "top", "hashed"])

    return base.arrow_map(plain, run, "n int, folds binary, dense binary, top binary, hashed binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(features, folds) of a row of packed features."""
    top = np.frombuffer(row["top"], "<f4")
    x = np.empty((row["n"], DENSE + DIMENSIONS), np.float32)
    x[:, :DENSE] = np.frombuffer(row["dense"], "<f4").reshape(row["n"], DENSE)
    np.multiply(np.frombuffer(zlib.decompress(row["hashed"]), np.uint8).reshape(row["n"], DIMENSIONS), (top / 255)[:, None], out=x[:, DENSE:])
    return x, np.frombuffer(row["folds"], np.uint8)


def summed(packed: DataFrame, function, size: int) -> np.ndarray:
    """The sum of function(features, folds), arrays of that size, over all packed rows; tasks add theirs, the driver gets the total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for k in range(batch.num_rows):
                total += function(*unpacked(batch.slice(k, 1).to_pylist()[0]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

    got = packed.mapInArrow(run, "x array<double>").select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def raw(model: Linear) -> tuple[np.ndarray, float]:
    """Weights and bias that give the model's margin on features as they are."""
    weights = model.weights / model.scale
    return weights.astype(np.float32), float(model.bias - model.center @ weights)


def unlabelled_sums(x: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Rows, their loss as negatives, and that loss's gradient by bias and by weights, of raw features."""
    z = x @ weights + bias
    s = sigmoid(z).astype(np.float32)
    return np.concatenate([[len(x), np.logaddexp(0, z).sum(dtype=np.float64), s.sum(dtype=np.float64)], x.T @ s])


def pu_risk(model: Linear, sums: np.ndarray, positive: np.ndarray, prior: float, decay: float) -> tuple[float, np.ndarray]:
    """The non-negative risk with decay, and the gradient by (weights, bias) that descends it; where the negative
    part is below zero its gradient is turned back."""
    n, loss, total = sums[:3]
    z = (positive.astype(np.float32) - model.center) / model.scale
    margin = z @ model.weights + model.bias
    negative = loss / n - prior * np.logaddexp(0, margin).mean()
    of_u = np.append((sums[3:] - model.center * total) / model.scale, total) / n
    value = prior * np.logaddexp(0, -margin).mean() + max(0.0, negative) + decay / 2 * float(model.weights @ model.weights)
    if negative >= 0:
        gradient = of_u - prior * np.append(z.mean(0), 1)
    else:
        s = sigmoid(margin)
        gradient = prior * np.append(z.T @ s, s.sum()) / len(z) - of_u
    return float(value), gradient + decay * np.append(model.weights, 0)


def refined(packed: DataFrame, positive: np.ndarray, sample: np.ndarray, model: Linear, prior: float, decay: float = 2e-3) -> Linear:
    """The model after STEPS descents of the risk over all unlabelled texts, preconditioned by the sample's curvature; the best of them."""
    z = np.concatenate([(sample.astype(np.float32) - model.center) / model.scale, np.ones((len(sample), 1), np.float32)], 1)
    s = sigmoid(z[:, :-1] @ model.weights + model.bias)
    curvature = ((z * (s * (1 - s))[:, None].astype(np.float32)).T @ z / len(z)).astype(np.float64)
    curvature[np.diag_indices_from(curvature)] += decay + DAMPING
    best, at = (np.inf, None), np.append(model.weights, model.bias)
    for _ in range(STEPS):
        now = Linear(model.center, model.scale, at[:-1], float(at[-1]))
        weights, bias = raw(now)
        sums = summed(packed, lambda x, _, w=weights, b=bias: unlabelled_sums(x, w, b), len(at) + 2)
        value, gradient = pu_risk(now, sums, positive, prior, decay)
        if value < best[0]:
            best, at = (value, now), at - np.linalg.solve(curvature, gradient)
        else:
            at = (at + np.append(best[1].weights, best[1].bias)) / 2
    return best[1] or model


def train_pu(docs: DataFrame, labels: DataFrame, training: Column, rows: int = SAMPLE) -> tuple[Linear, float]:
    """Operator 3's model and class prior: positives of training rows against the text of all training rows.

    A sample of both gives the first model, the classifiers of the prior and the curvature; the prior's shares
    and the risk are then taken over all unlabelled training texts.
    """
    positives = sampled_features(docs, labelled(labels, training).where("kind = '1'"), rows)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("string")
    ids = base.take(docs, "doc_id").select(F.col("doc_id").cast("long")).where("doc_id is not null").where(training).select("doc_id", fold.alias("kind"))
    sample = sampled_features(docs, ids, 2 * rows)
    if not positives or not sample:
        return neutral(), 0.5
    p, folds = positives["1"], (sample.get("0", sample.get("1")), sample.get("1", sample.get("0")))
    packed = base.stored(packed_features(docs, training))
    found = discriminators(p, folds)
    bars = [(*raw(model), np.log(bar / (1 - bar))) for model, bar, _ in found]

    def reach(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Rows of the other fold, and those that reach the bar, for each fold."""
        return np.array([v for k, (w, b, bar) in enumerate(bars) for v in ((of != k).sum(), (x[of != k] @ w + b >= bar).sum())], float)

    counts = summed(packed, reach, 4)
    own = [float((model.score(folds[k]) >= bar).mean()) for k, (model, bar, _) in enumerate(found)]
    prior = prior_of(found, [counts[2 * k + 1] / counts[2 * k] if counts[2 * k] else own[k] for k in (0, 1)])
    every = np.concatenate([sample[k] for k in sorted(sample)])
    model = refined(packed, p, every, fit_nnpu(p, every, prior), prior)
    base.release(packed)
    return model, prior


def scored(docs: DataFrame, model: Linear) -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = [shared.value.score(chunk.features()) for _, chunk in chunks(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return base.arrow_map(base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def rule_columns(docs: DataFrame, model: Linear, keep_at: float = KEEP_AT) -> DataFrame:
    """Counts, base verdict, score and verdict of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, chunk in chunks(batch.column(1)):
            repeats = chunk.repeat_words()
            failed = (chunk.n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * chunk.n_words)
            score = shared.value.score(chunk.features())
            counts = [chunk.n_words, chunk.word_chars(), chunk.count(_SYMBOL), chunk.dup_lines(), repeats]
            columns = [pa.array(np.asarray(c, np.int64)) for c in counts] + [pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= keep_at))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, chunk.texts), *columns], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return base.arrow_map(base.take(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), run, schema)


def kept_rows(docs: DataFrame, model: Linear, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged; no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(batch.num_rows, bool)
        for first, chunk in chunks(batch.column(at)):
            failed = (chunk.n_words < MIN_WORDS) | (100 * chunk.repeat_words() > MAX_REPEAT_PERCENT * chunk.n_words)
            keep[first : first + chunk.texts] = ~failed & (shared.value.score(chunk.features()) >= keep_at)
        yield batch.filter(pa.array(keep))

    return base.arrow_map(docs, run, docs.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    return rule_columns(docs, train_quality(docs, base.documents(spark, sf_dir, "labels")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 3) == 1
    model, _ = train_pu(docs, base.documents(spark, sf_dir, "labels"), ~held)
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
