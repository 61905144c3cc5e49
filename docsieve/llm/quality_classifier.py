"""Quality classifier: a sparse ensemble of conjunctive rules, compiled into Column expressions.

Documents are described by statistics of their text, made by built-in functions. Shallow boosted trees are grown on a bounded
sample of labelled rows (`max_rows`, chosen by hashes of their ids before any text is read); every path of a tree is a rule, a
conjunction of thresholds. A lasso-penalised logistic regression over the rules keeps few of them, its penalty chosen on a part
of the sample that it isn't fitted to. The kept rules and weights become one Column expression, so scoring is a projection.

Only the text is an input of a score. Rows whose crc32(id as text) mod 5 is 0 are held out: their labels are never read.

Defined results: null and empty texts are scored from statistics that are all 0; a null id is not held out and has no label;
texts of any length are measured whole; repeated rows are scored one by one, and of the texts of one id and label, the one with
the smallest statistics is trained on; rows with a null label are left out of training; without labels of both classes, or where
the statistics allow no split, the score is the share of label 1 (0.5 without any label); an empty table gives an empty result.
Few labels give small leaves: a leaf has a twentieth of the rows, 15 at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_col

FEATURES = ("words", "word_length", "symbols", "marks", "capitals", "letters", "digits", "lines", "double_lines", "distinct",
            "one_letter", "long_words", "ends")


def with_features(docs: DataFrame, text: str) -> DataFrame:
    """docs with the statistics f_<name>; helper columns start with _c_."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda pattern: F.length("_c_t") - F.length(F.regexp_replace("_c_t", pattern, ""))
    df = docs.withColumn("_c_t", t).withColumn("_c_w", words_col(F.col("_c_t")))
    df = df.withColumn("_c_l", F.filter(F.split("_c_t", "\n", -1), lambda x: x != ""))
    df = df.withColumns({"_c_n": F.size("_c_w"), "_c_m": F.size("_c_l"), "_c_c": F.length(F.array_join("_c_w", ""))})
    per = lambda x, n: F.coalesce(F.try_divide(x.cast("double"), F.col(n).cast("double")), F.lit(0.0))
    share = lambda f: per(F.size(F.filter("_c_w", f)), "_c_n")
    return df.withColumns({
        "f_words": F.col("_c_n").cast("double"),
        "f_word_length": per(F.col("_c_c"), "_c_n"),
        "f_symbols": per(without(r"[#*$%&|<>@^~\\{}=_+]+"), "_c_c"),
        "f_marks": per(without(r"[!?.,;:]+"), "_c_c"),
        "f_capitals": per(without(r"\p{Lu}+"), "_c_c"),
        "f_letters": per(without(r"\p{L}+"), "_c_c"),
        "f_digits": per(without(r"[0-9]+"), "_c_c"),
        "f_lines": per(F.col("_c_m"), "_c_n"),
        "f_double_lines": per(F.col("_c_m") - F.size(F.array_distinct("_c_l")), "_c_m"),
        "f_distinct": per(F.size(F.array_distinct("_c_w")), "_c_n"),
        "f_one_letter": share(lambda w: F.length(w) == 1),
        "f_long_words": share(lambda w: F.length(w) > 12),
        "f_ends": per(F.size(F.filter("_c_l", lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))), "_c_m"),
    })


@dataclass(frozen=True)
class RuleModel:
    """bias + the weights of the rules that hold, through the logistic function; a rule is ((feature, above, threshold), ...)."""

    bias: float
    rules: tuple[tuple[tuple[int, bool, float], ...], ...] = ()
    weights: tuple[float, ...] = ()

    def score(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for f, above, at in rule:
                c = F.col("f_" + FEATURES[f])
                holds = holds & ((c > at) if above else (c <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], y: np.ndarray, h: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list) -> None:
    """Grow a tree on gradients y and weights h; out gets the path and the value of every node."""
    leaf = max(1, min(15, len(y) // 20))
    if path:
        out.append((path, y[rows].sum() / (h[rows].sum() + 1.0), depth == 0))
    if depth == 0 or len(rows) < max(2, min(40, 3 * leaf)):
        if path:
            out[-1] = (*out[-1][:2], True)
        return
    best = (1e-6, None, None)
    for f, edges in enumerate(cuts):
        n = len(edges) + 1
        g = np.bincount(x[rows, f], y[rows], n)
        w = np.bincount(x[rows, f], h[rows], n)
        k = np.bincount(x[rows, f], minlength=n)
        gl, wl, kl = np.cumsum(g)[:-1], np.cumsum(w)[:-1], np.cumsum(k)[:-1]
        gain = gl**2 / (wl + 1) + (g.sum() - gl) ** 2 / (w.sum() - wl + 1) - g.sum() ** 2 / (w.sum() + 1)
        gain[(kl < leaf) | (len(rows) - kl < leaf)] = 0
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        if path:
            out[-1] = (*out[-1][:2], True)
        return
    _, f, b = best
    right = x[rows, f] > b
    for above, part in ((False, rows[~right]), (True, rows[right])):
        _grow(x, cuts, y, h, part, (*path, (f, above, float(cuts[f][b]))), depth - 1, out)


def _holds(v: np.ndarray, rule: tuple) -> np.ndarray:
    ok = np.ones(len(v), bool)
    for f, above, at in rule:
        ok &= (v[:, f] > at) if above else (v[:, f] <= at)
    return ok


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 250) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the bias (first) isn't penalised."""
    n = len(y)
    vec = np.ones(m.shape[1], np.float32)
    for _ in range(12):
        vec = m.T @ (m @ vec)
        vec /= np.linalg.norm(vec) + 1e-12
    rate = 4.0 * n / (float(np.linalg.norm(m @ vec)) ** 2 + n)
    z, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(m @ z + zb)))
        e = (p - y).astype(np.float32)
        w2 = z - rate * (m.T @ e) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - rate * penalty, 0)
        b2 = zb - rate * float(e.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2.astype(np.float32), b2, t2
        z = z.astype(np.float32)
    return w, b


def fit(v: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, most_rules: int = 60, seed: int = 5) -> RuleModel:
    """The model of statistics v (one row a document) and labels y (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(v[:, f], np.linspace(0.01, 0.99, 48))) for f in range(v.shape[1])]
    x = np.stack([np.searchsorted(c, v[:, f], "left") for f, c in enumerate(cuts)], 1)  # value <= cut k  <=>  bin <= k
    score = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes: list = []
        _grow(x, cuts, y - p, p * (1 - p), rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 40))], (), depth, nodes)
        for path, value, leaf in nodes:
            rules[tuple(sorted(path))] = None
            if leaf:
                score[_holds(v, path)] += 0.3 * value
    if not rules:
        return RuleModel(float(np.log(share / (1 - share))))
    names = list(rules)
    m = np.stack([_holds(v, r) for r in names], 1).astype(np.float32)
    test = rng.permutation(len(y)) % 4 == 0
    loss = lambda w, b, rows: float(np.mean(np.logaddexp(0, m[rows] @ w + b) - y[rows] * (m[rows] @ w + b)))
    start = (np.zeros(m.shape[1], np.float32), float(np.log(share / (1 - share))))
    best, w, b = (np.inf, 0.003), *start
    for penalty in (0.01, 0.005, 0.002, 0.001, 0.0005):
        w, b = _lasso(m[~test], y[~test], penalty, w, b)
        if (w != 0).sum() > 2 * most_rules:
            break
        best = min(best, (loss(w, b, test), penalty))
    w, b = _lasso(m, y, best[1], *start, steps=500)
    keep = np.argsort(-np.abs(w))[:most_rules]
    keep = np.sort(keep[w[keep] != 0])
    w, b = _lasso(m[:, keep], y, 1e-5, w[keep], b, steps=500)  # the penalty also shrinks what it keeps
    return RuleModel(float(b), tuple(names[k] for k in keep), tuple(float(u) for u in w))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                    max_rows: int = 20_000) -> DataFrame:
    """_y and the statistics of about max_rows labelled rows at most that aren't held out, a row for each id and label."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out("_id")).distinct()
    n = usable.count()
    if n > max_rows:  # a share of the hashes of ids that gives a twentieth less
        usable = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * 0.95 * max_rows / n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(usable), "_id")  # max_rows rows
    names = ["f_" + f for f in FEATURES]
    return with_features(rows, "_text").groupBy("_id", "_y").agg(F.min(F.struct(*names)).alias("_f")).select("_id", "_y", "_f.*")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> RuleModel:
    """Fit on about max_rows labelled rows at most that aren't held out."""
    rows = training_sample(docs, labels, id_col, text_col, label_col, max_rows).toPandas().sort_values(["_id", "_y"])
    return fit(rows.iloc[:, 2:].to_numpy(np.float64), rows["_y"].to_numpy(np.float64))


def classify(docs: DataFrame, model: RuleModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    # the row travels as one struct, so that no column of it is mistaken for a statistic
    rows = docs.select(F.struct(*(F.col(c) for c in keep)).alias("_c_row"), F.col(text_col).alias("_c_text"))
    out = with_features(rows, "_c_text").withColumn("score", model.score())
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).select(
        *(F.col("_c_row")[c].alias(c) for c in keep), "score", "predicted")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
