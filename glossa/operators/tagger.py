"""Linear-chain CRF taggers end to end: features, training, saving, loading, tagging, tuning.

A model is a matrix of weights over a fixed number of feature buckets and a matrix of moves between labels, so its size is set by a parameter
and it travels to tasks whole.  Training sums gradients by task and steps on the driver; tagging decodes sentences where they stand.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from glossa.functions import text as T
from glossa.operators.models import PRIORS, crf_gradient, decode_arrays, golden_section, lbfgs, marginals
from glossa.shared import written


_TABLE = ArrayType(ArrayType(DoubleType()))


@dataclass
class CrfModel:
    """labels, weights (buckets x labels), move (labels x labels)."""

    labels: list[str]
    weights: np.ndarray
    move: np.ndarray


def bucket(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode()) % buckets


def word_features(toks: Column) -> Column:
    """For each token of a sentence: word, shape, first and last letters, neighbours, and that any token is there."""

    def of(w: Column, i: Column) -> Column:
        before, after = F.coalesce(F.get(toks, i - 1), F.lit("<s>")), F.coalesce(F.get(toks, i + 1), F.lit("</s>"))
        shape = T.shape_dan2
        parts = [(w, "WORD"), (F.lower(w), "LOWER"), (shape(w), "TYPE"), (F.left(w, F.lit(3)), "PREFIX"), (F.right(w, F.lit(3)), "SUFFIX"), (before, "PW"), (after, "NW"), (shape(before), "PTYPE"), (shape(after), "NTYPE"), (F.lit("any"), "BIAS")]
        return F.array(*(F.concat(v, F.lit(f"-{n}|C")) for v, n in parts))

    return F.transform(toks, of)


def _hashed(features: pa.ListArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the feature offsets of tokens, the token offsets of sentences; each distinct feature is hashed once."""
    tokens = features.flatten()
    coded = tokens.flatten().dictionary_encode()
    number = np.fromiter((bucket(x, buckets) for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    at, of = np.asarray(features.offsets), np.asarray(tokens.offsets)
    return number[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64), of - of[0], at - at[0]


def _emissions(ids: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of each token's feature weights; a token without features has none."""
    total = np.zeros((len(ids) + 1, weights.shape[1]))
    np.cumsum(weights[ids], axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _gradients(sequences: DataFrame, labels: list[str], buckets: int, move: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of all sequences (features, gold) and its gradients; a row a task, summed over eight tasks before they reach the driver."""
    order = {y: i for i, y in enumerate(labels)}

    def partial(batches):
        gw, gm, value = np.zeros_like(weights), np.zeros_like(move), 0.0
        for batch in batches:
            ids, of, at = _hashed(batch.column("features"), buckets)
            emit = _emissions(ids, of, weights)
            slope = np.zeros_like(emit)
            for a, b, gold in zip(at[:-1].tolist(), at[1:].tolist(), batch.column("gold").to_pylist(), strict=True):
                if b > a:
                    one, slope[a:b], g = crf_gradient(emit[a:b], move, np.array([order[y] for y in gold]))
                    value += one
                    gm += g
            np.add.at(gw, ids, np.repeat(slope, np.diff(of), axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([gw.tobytes()], pa.binary()), pa.array([gm.tobytes()], pa.binary())], ["ll", "w", "m"])

    def summed(batches):
        ll, gw, gm = 0.0, np.zeros_like(weights), np.zeros_like(move)
        for batch in batches:
            for r in batch.to_pylist():
                ll, gw, gm = ll + r["ll"], gw + np.frombuffer(r["w"]).reshape(gw.shape), gm + np.frombuffer(r["m"]).reshape(gm.shape)
        yield pa.RecordBatch.from_arrays([pa.array([ll]), pa.array([gw.tobytes()], pa.binary()), pa.array([gm.tobytes()], pa.binary())], ["ll", "w", "m"])

    schema = "ll double, w binary, m binary"
    rows = sequences.select("features", "gold").mapInArrow(partial, schema).repartition(8).mapInArrow(summed, schema).collect()  # eight rows of the model's size
    total = [np.zeros_like(weights), np.zeros_like(move)]
    for r in rows:
        total[0] = total[0] + np.frombuffer(r["w"]).reshape(weights.shape)
        total[1] = total[1] + np.frombuffer(r["m"]).reshape(move.shape)
    return sum(r["ll"] for r in rows), *total


def train(sequences: DataFrame, labels: list[str], buckets: int = 4096, rounds: int = 20, sigma: float = 1.0, prior: str = "quadratic") -> CrfModel:
    """A model that makes the gold labels of sequences (features array<array<string>>, gold array<string>) likely, less the prior of its weights; L-BFGS."""
    data = written(sequences.select("features", "gold"))
    k = len(labels)
    cost, slope = PRIORS[prior]

    def split(x: np.ndarray):
        return x[: buckets * k].reshape(buckets, k), x[buckets * k :].reshape(k, k)

    def f(x: np.ndarray):
        w, m = split(x)
        ll, gw, gm = _gradients(data, labels, buckets, m, w)
        return float(np.sum(cost(x, sigma)) - ll), slope(x, sigma) - np.concatenate([gw.ravel(), gm.ravel()])

    best = lbfgs(f, np.zeros(buckets * k + k * k), rounds, tolerance=1e-3)
    return CrfModel(list(labels), *split(best))


def log_likelihood(sequences: DataFrame, model: CrfModel) -> float:
    return _gradients(sequences, model.labels, len(model.weights), model.move, model.weights)[0]


def tune_sigma(sequences: DataFrame, held_out: DataFrame, labels: list[str], low: float = 0.1, high: float = 10.0, steps: int = 6, **options) -> float:
    """The width of the prior under which held-out sequences are likeliest, by golden section over its logarithm."""
    return float(np.exp(golden_section(lambda s: -log_likelihood(held_out, train(sequences, labels, sigma=float(np.exp(s)), **options)), np.log(low), np.log(high), steps)))


def save(spark: SparkSession, model: CrfModel, path: str) -> None:
    """The model as a table (kind, ix, label, values); buckets without weight are left out."""
    rows = [("label", i, y, None) for i, y in enumerate(model.labels)] + [("move", i, None, r.tolist()) for i, r in enumerate(model.move)] + [("size", len(model.weights), None, None)]
    rows += [("weight", int(i), None, model.weights[i].tolist()) for i in np.flatnonzero(model.weights.any(1))]
    spark.createDataFrame(rows, "kind string, ix long, label string, values array<double>").write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> CrfModel:
    """A saved model; its size is what it was trained with."""
    rows = spark.read.parquet(path).collect()
    labels = [r["label"] for r in sorted((r for r in rows if r["kind"] == "label"), key=lambda r: r["ix"])]
    weights = np.zeros((next(r["ix"] for r in rows if r["kind"] == "size"), len(labels)))
    move = np.zeros((len(labels), len(labels)))
    for r in rows:
        if r["kind"] in ("weight", "move"):
            (weights if r["kind"] == "weight" else move)[r["ix"]] = r["values"]
    return CrfModel(labels, weights, move)


def emissions(df: DataFrame, model: CrfModel) -> DataFrame:
    """df with `features` replaced by `emit`: each token's scores by label."""
    rest = [c for c in df.columns if c != "features"]
    weights, buckets, k = model.weights, len(model.weights), len(model.labels)

    def run(batches):
        for batch in batches:
            ids, of, at = _hashed(batch.column("features"), buckets)
            flat = _emissions(ids, of, weights).ravel()
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, k), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)], [*rest, "emit"])

    fields = df.select(*rest).schema.add("emit", _TABLE)
    return df.select(*rest, "features").mapInArrow(run, fields)


def tag(df: DataFrame, model: CrfModel, method: str = "viterbi") -> DataFrame:
    """df with `features` replaced by `path` (labels) and `path_score`."""
    return decode_arrays(emissions(df, model), model.labels, model.move, method)


def probabilities(df: DataFrame, model: CrfModel) -> DataFrame:
    """df with `features` replaced by `p`: each token's probabilities by label."""
    scored = emissions(df, model)
    rest, move = [c for c in scored.columns if c != "emit"], model.move

    def run(batches):
        for batch in batches:
            p = [marginals(np.array(e), move).tolist() if e else [] for e in batch.column("emit").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(p, pa.list_(pa.list_(pa.float64())))], [*rest, "p"])

    return scored.mapInArrow(run, scored.select(*rest).schema.add("p", _TABLE))


def step(model: CrfModel, by: str = "doc_id"):
    """The tagger as one step of a named-entity pipe: tokens (by, pos, tok) to (by, pos, label)."""

    def run(tokens: DataFrame) -> DataFrame:
        rows = tokens.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_t"))
        tagged = tag(rows.select(by, F.col("_t.pos").alias("_pos"), word_features(F.col("_t.tok")).alias("features")), model)
        return tagged.select(by, F.inline(F.arrays_zip(F.col("_pos").alias("pos"), F.col("path").alias("label"))))

    return run
