"""Linear sequence models: scoring by joins with a weight table, decoding and training by numpy per sequence.

Features are rows (key..., feature), weights (feature, label, w).  Scores are a join and a sum; only dynamic programs run in Python, one
bounded sentence at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from glossa.operators.sets import indexed
from glossa.shared import written


#: Labels up to which a feature's weights travel as one row.
_WIDE = 64


def scores(features: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos"), bias: dict[str, float] | None = None) -> DataFrame:
    """(keys, label, score): unseen features count nothing; `bias` adds a constant to labels.

    A model of few labels is joined as one row a feature with a column a label: features are not multiplied by labels, and all of a key's
    scores come from one aggregation, so what is done by key next needs no shuffle.
    """
    known = [r[0] for r in weights.select("label").distinct().limit(_WIDE + 1).collect()]  # labels of a model, few by nature
    if len(known) <= _WIDE and None not in known:
        columns = {f"_w{i}": y for i, y in enumerate(sorted(known))}
        wide = weights.groupBy("feature").agg(*(F.sum(F.when(F.col("label") == y, F.col("w"))).alias(c) for c, y in columns.items()))
        summed = features.join(wide, "feature").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))
        each = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(y).alias("label"), F.col(c).alias("score"))) for c, y in columns.items()))
        s = summed.select(*keys, F.inline(F.array_compact(each))) if columns else features.join(weights, "feature").select(*keys, "label", F.col("w").alias("score"))
    else:
        s = features.join(weights, "feature").groupBy(*keys, "label").agg(F.sum("w").alias("score"))
    if bias:
        table = F.create_map(*(F.lit(x) for kv in bias.items() for x in kv))
        s = s.withColumn("score", F.col("score") + F.coalesce(table[F.col("label")], F.lit(0.0)))
    return s


def log_probabilities(s: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    w = Window.partitionBy(*keys)
    top = F.max("score").over(w)
    return s.withColumn("_top", top).withColumn("logp", F.col("score") - F.col("_top") - F.log(F.sum(F.exp(F.col("score") - F.col("_top"))).over(w))).drop("_top")


def classify(s: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos"), threshold: float | None = None, background: str = "O") -> DataFrame:
    """(keys, label, logp): best label of each key; ties go to the smaller label; below the threshold probability the background."""
    top = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("r"), "label"))).alias("_s"))  # as many as labels
    best = F.col("_s")[0]
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(best["r"] - x["r"]))
    out = top.select(*keys, best["label"].alias("label"), (-F.log(total)).alias("logp"))
    if threshold is None:
        return out
    return out.withColumn("label", F.when(F.exp("logp") >= threshold, F.col("label")).otherwise(background))


def justification(features: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Each active feature's weight by label."""
    return features.join(weights, "feature").select(*keys, "feature", "label", "w")


def top_weights(weights: DataFrame, k: int) -> DataFrame:
    return weights.orderBy(F.desc(F.abs("w")), "feature", "label").limit(k)


def weight_histogram(weights: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    return weights.groupBy(F.expr(f"width_bucket(w, {low}, {high}, {bins})").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def prune_by_range(weights: DataFrame, threshold: float) -> DataFrame:
    keep = weights.groupBy("feature").agg((F.max("w") - F.min("w")).alias("r")).where(F.col("r") > threshold)
    return weights.join(keep, "feature", "left_semi")


def combine(a: DataFrame, wa: float, b: DataFrame, wb: float) -> DataFrame:
    """Weighted sum of two weight tables over the union of their features."""
    return a.select("feature", "label", (F.col("w") * wa).alias("w")).union(b.select("feature", "label", (F.col("w") * wb).alias("w"))).groupBy("feature", "label").agg(F.sum("w").alias("w"))


def index_of(values: DataFrame, column: str, first: str | None = None) -> DataFrame:
    """0-based ids of distinct values in order, `first` before all; numbered by range partitions."""
    order = [F.col(column) != first, F.col(column)] if first else [F.col(column)]
    return indexed(values.select(column).distinct(), *order, name="id").select(column, F.col("id").cast("long").alias("id"))


def data_log_likelihood(s: DataFrame, gold: DataFrame, weights: DataFrame | None = None, sigma: float | None = None, keys: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Sum of the gold labels' log-probabilities, less the quadratic penalty of the weights."""
    ll = log_probabilities(s, keys).join(gold, [*keys, "label"]).agg(F.sum("logp").alias("ll"))
    if weights is None or sigma is None:
        return ll
    pen = weights.agg((F.sum(F.col("w") * F.col("w")) / (2 * sigma * sigma)).alias("pen"))
    return ll.crossJoin(F.broadcast(pen)).select((F.col("ll") - F.col("pen")).alias("ll"))


def naive_bayes(features: DataFrame, labels: DataFrame, sigma: float = 1.0, always_on_is_prior: bool = True) -> DataFrame:
    """(feature, label, w) of binary features: log of P(c | f) over P(c).

    P(c | f) = (n(f, c) + s) / (n(f) + s C) with C labels; P(c) is the share of the active features that examples of c hold.  A feature that every example
    has is a prior instead: the log of its label's share of examples.
    """
    examples = labels.agg(F.count("*").cast("double").alias("examples"))
    share = labels.groupBy("label").agg(F.count("*").cast("double").alias("numc"))
    data = features.select("example_id", "feature").distinct().join(labels, "example_id")
    fc = data.groupBy("feature", "label").agg(F.count("*").cast("double").alias("nfc"))
    per_label = share.join(fc.groupBy("label").agg(F.sum("nfc").alias("nc")), "label", "left").na.fill(0, ["nc"])  # as many rows as labels
    totals = per_label.agg(F.sum("nc").alias("n"), F.count("*").alias("labels"))
    by = per_label.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(examples))
    grid = fc.groupBy("feature").agg(F.sum("nfc").alias("nf")).crossJoin(F.broadcast(by)).join(fc, ["feature", "label"], "left").na.fill(0, ["nfc"])
    tiny = 1e-30  # keeps a label without features from dividing by nothing
    given, base = (F.col("nfc") + sigma) / (F.col("nf") + sigma * F.col("labels")), (F.col("nc") + tiny) / (F.col("n") + F.col("labels") * tiny)
    w = F.log(given / base)
    if always_on_is_prior:
        w = F.when(F.col("nf") == F.col("examples"), F.log(F.col("numc") / F.col("examples"))).otherwise(w)
    return grid.select("feature", "label", w.alias("w"))


# --- dynamic programs -------------------------------------------------------------------------------------------------------


def viterbi_path(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, float]:
    """Best path; the earliest predecessor wins a tie."""
    n, k = emit.shape
    best, back = emit[0].copy(), np.zeros((n, k), np.int64)
    for t in range(1, n):
        s = best[:, None] + move
        back[t] = s.argmax(0)
        best = s[back[t], np.arange(k)] + emit[t]
    path = np.zeros(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(best.max())


def k_best_paths(emit: np.ndarray, move: np.ndarray, k: int) -> list[tuple[np.ndarray, float]]:
    """The k best label sequences by falling score."""
    n, m = emit.shape
    heads = [[(emit[0, y], (y,))] for y in range(m)]
    for t in range(1, n):
        heads = [sorted(((s + move[p[-1], y] + emit[t, y], (*p, y)) for h in heads for s, p in h), key=lambda x: (-x[0], x[1]))[:k] for y in range(m)]
    out = sorted((x for h in heads for x in h), key=lambda x: (-x[0], x[1]))[:k]
    return [(np.array(p), float(s)) for s, p in out]


def beam_path(emit: np.ndarray, move: np.ndarray, width: int = 30) -> tuple[np.ndarray, float]:
    beam = sorted(((float(emit[0, y]), (y,)) for y in range(emit.shape[1])), key=lambda x: (-x[0], x[1]))[:width]
    for t in range(1, len(emit)):
        beam = sorted(((s + float(move[p[-1], y] + emit[t, y]), (*p, y)) for s, p in beam for y in range(emit.shape[1])), key=lambda x: (-x[0], x[1]))[:width]
    return np.array(beam[0][1]), beam[0][0]


def marginals(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(label | position) by forward and backward sums in log space."""
    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

    n = len(emit)
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[0] = emit[0]
    for t in range(1, n):
        a[t] = emit[t] + lse(a[t - 1][:, None] + move, 0)
    for t in range(n - 2, -1, -1):
        b[t] = lse(move + (emit[t + 1] + b[t + 1])[None, :], 1)
    z = lse(a[-1], 0)
    return np.exp(a + b - z)


def gibbs_path(emit: np.ndarray, move: np.ndarray, sweeps: int = 50, seed: int = 0, cooling: str = "linear", prior=None) -> tuple[np.ndarray, float]:
    """Annealed Gibbs sampling; the best sequence seen.  `prior` gives a score (0 or less) of a whole sequence, for what reaches beyond neighbours."""
    rng = np.random.default_rng(seed)
    n, k = emit.shape
    y = emit.argmax(1)

    def total(v):
        return float(emit[np.arange(n), v].sum() + move[v[:-1], v[1:]].sum()) + (prior(v) if prior else 0.0)

    best, best_score = y.copy(), total(y)
    for sweep in range(sweeps):
        heat = max(1e-3, 1 - sweep / sweeps) if cooling == "linear" else 0.9**sweep
        for t in range(n):
            s = emit[t].copy()
            if t:
                s += move[y[t - 1]]
            if t + 1 < n:
                s += move[:, y[t + 1]]
            if prior:
                for label in range(k):
                    y[t] = label
                    s[label] += prior(y)
            p = np.exp((s - s.max()) / heat)
            y[t] = rng.choice(k, p=p / p.sum())
        if (now := total(y)) > best_score:
            best, best_score = y.copy(), now
    return best, best_score


def sample_path(emit: np.ndarray, move: np.ndarray, seed: int = 0) -> np.ndarray:
    """One sequence drawn from the model: backward sums, then forward draws."""
    rng = np.random.default_rng(seed)
    n, k = emit.shape
    b = np.zeros_like(emit)
    for t in range(n - 2, -1, -1):
        x = move + (emit[t + 1] + b[t + 1])[None, :]
        m = x.max(1)
        b[t] = m + np.log(np.exp(x - m[:, None]).sum(1))
    y = np.zeros(n, np.int64)
    for t in range(n):
        s = emit[t] + b[t] + (move[y[t - 1]] if t else 0)
        p = np.exp(s - s.max())
        y[t] = rng.choice(k, p=p / p.sum())
    return y


def consistency_penalty(words: list[str], path: np.ndarray, weight: float) -> float:
    """Non-local prior: each word given several labels costs `weight` for each label beyond its first."""
    seen: dict[str, set[int]] = {}
    for w, y in zip(words, path.tolist(), strict=True):
        seen.setdefault(w, set()).add(y)
    return -weight * sum(len(v) - 1 for v in seen.values())


def entities_of(words: list[str], path: np.ndarray, background: int) -> list[tuple[tuple[str, ...], int]]:
    """Runs of one label other than the background, as words and label."""
    out, k = [], 0
    while k < len(path):
        j = k
        while j < len(path) and path[j] == path[k]:
            j += 1
        if path[k] != background:
            out.append((tuple(words[k:j]), int(path[k])))
        k = j
    return out


def entity_prior(words: list[str], background: int, costs: np.ndarray, part_costs: np.ndarray):
    """Prior over a document's entities: `costs[x, y]` for each pair of equal entities labelled x and y, `part_costs` where one is part of the other."""

    def score(path: np.ndarray) -> float:
        found, out = entities_of(words, path, background), 0.0
        for i, (a, x) in enumerate(found):
            for b, y in found[i + 1 :]:
                if a == b:
                    out -= costs[x, y]
                else:
                    small, large = sorted((a, b), key=len)
                    if any(large[k : k + len(small)] == small for k in range(len(large) - len(small) + 1)):
                        out -= part_costs[x, y]
        return out

    return score


def slot_prior(words: list[str], single: dict[int, float]):
    """Prior of texts with slots: a label that should be filled by one phrase costs its weight for each further phrase."""

    def score(path: np.ndarray) -> float:
        out = 0.0
        for label, weight in single.items():
            at = np.flatnonzero(path == label)
            runs = {tuple(words[k] for k in r) for r in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(r)}
            out -= weight * max(0, len(runs) - 1)
        return out

    return score


def uniform_prior(path: np.ndarray) -> float:
    return 0.0


METHODS = {"viterbi": viterbi_path, "beam": beam_path, "gibbs": gibbs_path}


def viterbi_batch(emit: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of many sequences at once: emissions padded to (sequences, longest, labels), longest first.  The earliest predecessor wins a tie."""
    m, longest, k = emit.shape
    best, back = emit[:, 0].copy(), np.zeros((m, longest, k), np.int16)
    for t in range(1, longest):
        live = int(np.searchsorted(-length, -t))  # sequences longer than t
        s = best[:live, :, None] + move
        back[:live, t] = s.argmax(1)
        best[:live] = s.max(1) + emit[:live, t]
    path = np.zeros((m, longest), np.int64)
    now = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-length, -t))
        path[:live, t] = now[:live]
        if t:
            now[:live] = back[np.arange(live), t, now[:live]]
    return path, best.max(1)


def decode_arrays(df: DataFrame, labels: list[str], move: np.ndarray, method: str = "viterbi", cells: int = 1 << 21) -> DataFrame:
    """df with its column `emit` (array<array<double>>: a sequence's scores by position and label) replaced by `path` (array<string>) and `path_score`.

    Sequences are decoded where they stand, nothing is shuffled; Viterbi takes sequences of a batch together, ordered by length and in groups of bounded size.
    """
    names, single, k = np.array(labels, object), METHODS[method], len(labels)
    rest = [f for f in df.schema.fields if f.name != "emit"]
    schema = StructType([*rest, StructField("path", ArrayType(StringType())), StructField("path_score", DoubleType())])

    def run(batches):
        for batch in batches:
            raw = batch.column("emit")
            n = np.diff(np.asarray(raw.offsets)).astype(np.int64)
            flat = raw.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            begin = np.cumsum(n) - n
            paths, value = [[] for _ in n], np.zeros(len(n))
            order, at = np.argsort(-n, kind="stable"), 0
            order = order[: int((n > 0).sum())]
            while at < len(order):
                longest = int(n[order[at]])
                some = order[at : at + max(1, cells // (longest * k))]
                at += len(some)
                if method == "viterbi":
                    emit = np.zeros((len(some), longest, k))
                    inside = np.arange(longest) < n[some][:, None]
                    emit[inside] = flat[np.repeat(begin[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))]
                    best, score = viterbi_batch(emit, n[some], move)
                else:
                    both = [single(flat[begin[i] : begin[i] + n[i]], move) for i in some.tolist()]
                    best, score = [p for p, _ in both], [v for _, v in both]
                value[some] = score
                for i, p in zip(some.tolist(), best, strict=True):
                    paths[i] = names[p[: n[i]]].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(paths, pa.list_(pa.string())), pa.array(value)], [f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def decode(s: DataFrame, labels: list[str], move: np.ndarray, keys: tuple[str, ...] = ("doc_id", "sent_id"), method: str = "viterbi") -> DataFrame:
    """(keys, pos, label, path_score): s holds keys, pos, label, score; label pairs that `move` sets to -inf are never used; a label without a score is as good as never."""
    order = F.create_map(*(F.lit(x) for i, y in enumerate(labels) for x in (y, i)))
    none = F.array(*[F.lit(-1e9)] * len(labels))
    cell = s.groupBy(*keys, "pos").agg(F.map_from_entries(F.collect_list(F.struct(order[F.col("label")].alias("k"), F.col("score").cast("double").alias("v")))).alias("_m"))
    emit = F.transform(none, lambda x, i: F.coalesce(F.col("_m")[i], x))
    rows = cell.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", emit.alias("e")))).alias("_r"))
    out = decode_arrays(rows.select(*keys, F.col("_r.pos").alias("_pos"), F.col("_r.e").alias("emit")), labels, move, method)
    return out.select(*keys, F.inline(F.arrays_zip(F.col("_pos").alias("pos"), F.col("path").alias("label"))), "path_score").select(*keys, "pos", "label", "path_score")


def posterior(s: DataFrame, labels: list[str], move: np.ndarray, keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    order = {y: i for i, y in enumerate(labels)}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(pdf["pos"].unique())
        emit = np.full((len(pos), len(labels)), -1e9)
        emit[np.searchsorted(pos, pdf["pos"]), pdf["label"].map(order)] = pdf["score"]
        p = marginals(emit, move)
        out = {k: [pdf[k].iloc[0]] * p.size for k in keys}
        return pd.DataFrame(out | {"pos": np.repeat(pos, len(labels)), "label": labels * len(pos), "p": p.reshape(-1)})

    kinds = ", ".join(f"{k} {s.schema[k].dataType.simpleString()}" for k in keys)
    return s.groupBy(*keys).applyInPandas(one, f"{kinds}, pos {s.schema['pos'].dataType.simpleString()}, label string, p double")


# --- training ---------------------------------------------------------------------------------------------------------------

#: Penalties and their gradients by weight.
PRIORS = {
    "null": (lambda w, s: 0.0 * w, lambda w, s: 0.0 * w),
    "quadratic": (lambda w, s: w * w / (2 * s * s), lambda w, s: w / (s * s)),
    "huber": (lambda w, s: np.where(np.abs(w) < 1, w * w / 2, np.abs(w) - 0.5) / (s * s), lambda w, s: np.clip(w, -1, 1) / (s * s)),
    "quartic": (lambda w, s: w**4 / (4 * s**4), lambda w, s: w**3 / s**4),
    "cosh": (lambda w, s: np.log(np.cosh(w / s)), lambda w, s: np.tanh(w / s) / s),
}


def train_maxent(features: DataFrame, labels: DataFrame, rounds: int = 30, sigma: float = 1.0, prior: str = "quadratic", rate: float = 1.0) -> DataFrame:
    """(feature, label, w) by full-batch gradient steps on tables: scores are a join, gradients a group sum, weights stay distributed.

    The step for a feature is divided by its count, which bounds the curvature of its column; weights are written every few rounds, which cuts their lineage.
    """
    penalty = {"quadratic": lambda w: w / (sigma * sigma), "null": lambda w: F.lit(0.0), "huber": lambda w: F.greatest(F.least(w, F.lit(1.0)), F.lit(-1.0)) / (sigma * sigma), "quartic": lambda w: w * w * w / sigma**4, "cosh": lambda w: F.tanh(w / sigma) / sigma}[prior]
    classes = labels.select("label").distinct()  # few by nature
    data = features.select("example_id", "feature").distinct().join(labels, "example_id")
    count = data.groupBy("feature").agg(F.count("*").cast("double").alias("nf"))
    weights = count.crossJoin(F.broadcast(classes)).withColumn("w", F.lit(0.0))
    gold = data.groupBy("feature", "label").agg(F.count("*").cast("double").alias("observed"))
    base = data.select("example_id", "feature")
    for k in range(rounds):
        p = log_probabilities(scores(base, weights.select("feature", "label", "w"), ("example_id",)), ("example_id",))
        expected = base.join(p, "example_id").groupBy("feature", "label").agg(F.sum(F.exp("logp")).alias("expected"))
        grad = weights.join(expected, ["feature", "label"], "left").join(gold, ["feature", "label"], "left").na.fill(0, ["expected", "observed"])
        weights = grad.select("feature", "nf", "label", (F.col("w") + rate * (F.col("observed") - F.col("expected") - penalty(F.col("w"))) / F.col("nf")).alias("w"))
        if k % 5 == 4:
            weights = written(weights)
    return weights.select("feature", "label", "w")


def crf_gradient(emit: np.ndarray, move: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of a sequence and its gradients by emissions and moves."""
    n, k = emit.shape
    p = marginals(emit, move)
    g_emit = -p
    g_emit[np.arange(n), gold] += 1
    g_move = np.zeros_like(move)
    np.add.at(g_move, (gold[:-1], gold[1:]), 1.0)
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    lse = lambda x, axis: np.logaddexp.reduce(x, axis)
    a[0] = emit[0]
    for t in range(1, n):
        a[t] = emit[t] + lse(a[t - 1][:, None] + move, 0)
    for t in range(n - 2, -1, -1):
        b[t] = lse(move + (emit[t + 1] + b[t + 1])[None, :], 1)
    z = lse(a[-1], 0)
    for t in range(1, n):
        g_move -= np.exp(a[t - 1][:, None] + move + (emit[t] + b[t])[None, :] - z)
    score = emit[np.arange(n), gold].sum() + move[gold[:-1], gold[1:]].sum()
    return float(score - z), g_emit, g_move


def golden_section(f, low: float, high: float, rounds: int = 30) -> float:
    """Argument of the least value of a one-dimensional function (for tuning sigma)."""
    g = (5**0.5 - 1) / 2
    c, d = high - g * (high - low), low + g * (high - low)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc < fd:
            high, d, fd = d, c, fc
            c = high - g * (high - low)
            fc = f(c)
        else:
            low, c, fc = c, d, fd
            d = low + g * (high - low)
            fd = f(d)
    return (low + high) / 2


def lbfgs(f, x: np.ndarray, rounds: int = 100, memory: int = 10, tolerance: float = 1e-7) -> np.ndarray:
    """Least value of f, which returns value and gradient."""
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.linalg.norm(g) < tolerance:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        step = 1.0
        while True:
            new = x - step * q
            v, ng = f(new)
            if v <= value - 1e-4 * step * (g @ q) or step < 1e-10:
                break
            step /= 2
        s, y = new - x, ng - g
        if y @ s > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, g = new, v, ng
    return x


def conjugate_gradient(f, x: np.ndarray, rounds: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """Least value of f, which returns value and gradient: Polak and Ribiere's directions, steps halved until they pay."""
    value, g = f(x)
    d = -g
    for _ in range(rounds):
        if np.linalg.norm(g) < tolerance:
            break
        if d @ g >= 0:
            d = -g
        step = 1.0
        while True:
            new = x + step * d
            v, ng = f(new)
            if v <= value + 1e-4 * step * (g @ d) or step < 1e-12:
                break
            step /= 2
        beta = max(0.0, ng @ (ng - g) / max(g @ g, 1e-300))
        x, value, g, d = new, v, ng, -ng + beta * d
    return x


def sgd(f, n: int, x: np.ndarray, rounds: int = 20, batch: int = 16, rate: float = 0.1, decay: float = 0.01, seed: int = 0, scaled: bool = False) -> np.ndarray:
    """Stochastic descent over n examples: f(x, rows) gives value and gradient of some of them.  With `scaled` each weight's step shrinks with its own gradients."""
    rng, seen, t = np.random.default_rng(seed), np.zeros_like(x), 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            _, g = f(x, order[k : k + batch])
            seen += g * g
            step = rate / np.sqrt(seen + 1e-8) if scaled else rate / (1 + decay * t)
            x, t = x - step * g, t + 1
    return x


def meta_descent(f, n: int, x: np.ndarray, rounds: int = 20, batch: int = 16, rate: float = 0.05, meta: float = 0.05, seed: int = 0) -> np.ndarray:
    """Stochastic descent whose gain for each weight grows while its gradients agree and shrinks while they do not."""
    rng, gain, before = np.random.default_rng(seed), np.full_like(x, rate), np.zeros_like(x)
    for _ in range(rounds):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            _, g = f(x, order[k : k + batch])
            gain *= np.clip(1 + meta * np.sign(g * before), 0.5, 2)
            x, before = x - gain * g, g
    return x


def hybrid(f_some, f_all, n: int, x: np.ndarray, rounds: int = 3, **options) -> np.ndarray:
    """Some rounds of stochastic descent, then L-BFGS from there."""
    return lbfgs(f_all, sgd(f_some, n, x, rounds, **options))


OPTIMISERS = {"lbfgs": lbfgs, "conjugate_gradient": conjugate_gradient, "sgd": sgd, "meta_descent": meta_descent, "hybrid": hybrid}
