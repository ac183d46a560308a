"""Small learners in numpy: naive Bayes support vectors and non-negative positive-unlabelled learning."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_count_ratio(row: np.ndarray, feature: np.ndarray, y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the indicator counts of both classes, smoothed by ``alpha``."""
    up = y[row] == 1
    p = alpha + np.bincount(feature[up], minlength=size)
    q = alpha + np.bincount(feature[~up], minlength=size)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_dual(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; a row is its features and their values; the last weight is the bias."""
    w = np.zeros(size + 1)
    a = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            g = y[i] * (w[f] @ v + w[size]) - 1.0
            new = min(max(a[i] - g / norm[i], 0.0), cost[i])
            step = (new - a[i]) * y[i]
            if step:
                w[f] += step * v
                w[size] += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-4:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a sigmoid through margins, by Newton's method with smoothed targets."""
    n1, n0 = float((y == 1).sum()), float((y != 1).sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([d @ margin, d.sum()])
        H = np.array([[h @ (margin * margin) + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(H, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def split_rows(row: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    cuts = np.searchsorted(row, np.arange(n + 1))
    return [feature[cuts[i] : cuts[i + 1]] for i in range(n)]


def nb_svm(texts: list[np.ndarray], y: np.ndarray, size: int, least: int = 3, cost: float = 1.0, beta: float = 0.25, folds: int = 3, seed: int = 0) -> dict:
    """Fit on the features of each text and labels 0/1; returns dense ``weights`` and ``scale``, ``bias`` and the sigmoid.

    A text's vector is the log-count ratio of each of its known features, scaled to unit length. With one class only the
    score is that class's smoothed share.
    """
    n = len(texts)
    share = (float((y == 1).sum()) + 1) / (n + 2)
    blank = {"weights": np.zeros(size, np.float32), "scale": np.zeros(size, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    if n < 4 or len(set(y.tolist())) < 2:
        return blank

    def fit(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        row = np.repeat(np.arange(len(ids)), [len(texts[i]) for i in ids])
        feature = np.concatenate([texts[i] for i in ids])
        known = np.bincount(feature, minlength=size) >= least
        keep = known[feature]
        r = np.where(known, log_count_ratio(row[keep], feature[keep], y[ids], size), 0.0)
        vectors = []
        for i in ids:
            f = texts[i][known[texts[i]]]
            v = r[f]
            vectors.append((f, v / max(1e-9, float(np.sqrt(v @ v)))))
        sign = np.where(y[ids] == 1, 1.0, -1.0)
        rare = {1.0: (sign > 0).mean(), -1.0: (sign < 0).mean()}
        c = np.array([cost * min(0.5 / max(rare[s], 1e-6), 10.0) for s in sign])
        w = hinge_dual(vectors, sign, size, c, seed=seed)
        mean = np.abs(w[:size]).sum() / max(1, known.sum())
        return r, (1 - beta) * mean * known + beta * w[:size] if beta < 1 else w[:size], float(w[size])

    def margin(model: tuple[np.ndarray, np.ndarray, float], ids: np.ndarray) -> np.ndarray:
        r, w, b = model
        out = []
        for i in ids:
            v = r[texts[i]]
            out.append(float(w[texts[i]] @ v) / max(1e-9, float(np.sqrt(v @ v))) + b)
        return np.array(out)

    order = np.random.default_rng(seed).permutation(n)
    held = np.zeros(n)
    for k in range(folds):
        out = order[k::folds]
        rest = np.setdiff1d(order, out)
        held[out] = margin(fit(rest), out) if len(set(y[rest].tolist())) == 2 else 0.0
    slope, offset = platt(held, y)
    r, w, b = fit(np.arange(n))
    return {"weights": (w * r).astype(np.float32), "scale": (r * r).astype(np.float32), "bias": b, "slope": slope, "offset": offset}


def apply(model: dict, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Scores in (0, 1) of n texts from their distinct features; a model may hold all weights or those of its ``known`` features."""
    if "known" in model:
        at = np.minimum(np.searchsorted(model["known"], feature), max(0, len(model["known"]) - 1))
        hit = model["known"][at] == feature if len(model["known"]) else np.zeros(len(feature), bool)
        row, feature = row[hit], at[hit]
    total = np.bincount(row, model["weights"][feature], minlength=n)
    if "scale" in model:
        total = total / np.maximum(1e-9, np.sqrt(np.bincount(row, model["scale"][feature], minlength=n)))
    return sigmoid(model["slope"] * (total + model["bias"]) + model["offset"])


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 200, batch: int = 2048, rate: float = 0.05, decay: float = 5e-5, beta: float = 0.0, gamma: float = 1.0, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a linear classifier by the non-negative PU risk with logistic loss.

    Risk = prior * E_p[l(g)] + max(-beta, E_u[l(-g)] - prior * E_p[l(-g)]); where a batch's second part falls under -beta,
    the step goes up its gradient instead, by ``gamma``.
    """
    dims = positive.shape[1]
    w = np.zeros(dims + 1)
    w[dims] = np.log(prior / (1 - prior))
    m, v = np.zeros(dims + 1), np.zeros(dims + 1)
    rng = np.random.default_rng(seed)
    steps = max(1, -(-len(unlabelled) // batch))
    t = 0
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for s in range(steps):
            p, u = positive[p_order[s::steps]], unlabelled[u_order[s::steps]]
            if not len(p) or not len(u):
                continue
            gp, gu = sigmoid(p @ w[:dims] + w[dims]), sigmoid(u @ w[:dims] + w[dims])
            lost = float(-np.log(np.maximum(1 - gu, 1e-12)).mean()) - prior * float(-np.log(np.maximum(1 - gp, 1e-12)).mean())
            dp, du = gp / len(p), gu / len(u)
            negative = np.concatenate([u.T @ du - prior * (p.T @ dp), [du.sum() - prior * dp.sum()]])
            if lost >= -beta:
                dp1 = (gp - 1) / len(p)
                g = prior * np.concatenate([p.T @ dp1, [dp1.sum()]]) + negative
            else:
                g = -gamma * negative
            g[:dims] += decay * w[:dims]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (1 - (t - 1) / (epochs * steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def pu_platt(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steepest: float = 5.0) -> tuple[float, float]:
    """Slope and offset of a sigmoid through margins.

    The offset makes the unlabelled texts' mean score the class prior; of slopes from 1 to ``steepest`` the one of the
    lowest corrected risk, E_u[softplus(g)] - prior * E_p[g], is taken.
    """
    best = (np.inf, 1.0, 0.0)
    for slope in np.linspace(1.0, steepest, 17):
        low, high = -60.0 - slope * unlabelled.max(), 60.0 - slope * unlabelled.min()
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if sigmoid(slope * unlabelled + middle).mean() < prior else (low, middle)
        risk = float(np.logaddexp(0, slope * unlabelled + low).mean() - prior * (slope * positive + low).mean())
        best = min(best, (risk, float(slope), float(low)))
    return best[1], best[2]
