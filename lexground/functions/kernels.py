"""Dynamic programmes and densities of one example or one Arrow batch, in NumPy. Parameters are small arrays."""

from __future__ import annotations

import math

import numpy as np


def log_sum_exp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def squared_distances(x: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Of every row to every centroid, as one matrix product."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ mu.T + (mu * mu).sum(1)[None], 0)


def rbf_posterior(x: np.ndarray, mu: np.ndarray, width: float) -> np.ndarray:
    s = -squared_distances(x, mu) / width
    return np.exp(s - log_sum_exp(s)[:, None])


def uniforms(key: int, n: int) -> np.ndarray:
    """``n`` numbers in (0, 1) from a 64-bit key (splitmix)."""
    with np.errstate(over="ignore"):
        z = np.uint64(key & (2**64 - 1)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2**53


# Alignment of positions to regions: pi[n, K] concept posteriors of the regions, init[n], trans[n, n], b[T, K] emissions.


def hmm_forward(pi: np.ndarray, init: np.ndarray, trans: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled f[T, ..., n, K] and log scales; a leading batch axis of ``pi`` is kept. Staying in a region keeps its concept."""
    stay, move = np.diag(trans), trans - np.diag(np.diag(trans))
    f = init[:, None] * pi * b[0]
    out, logs = [], []
    for t in range(len(b)):
        if t:
            came = np.einsum("...i,ij->...j", f.sum(-1), move)
            f = (stay[:, None] * f + came[..., None] * pi) * b[t]
        z = np.maximum(f.sum((-2, -1), keepdims=True), 1e-300)
        f = f / z
        out.append(f)
        logs.append(np.log(np.squeeze(z, (-2, -1))))
    return np.array(out), np.array(logs)


def hmm_estep(pi: np.ndarray, init: np.ndarray, trans: np.ndarray, b: np.ndarray, init_counts: str = "all") -> dict:
    """Expected counts of one example: init[n], trans[n, n], gamma[T, K], concept[n, K], and the log-likelihood."""
    e = hmm_estep_many(pi[None], init, trans, b[None], init_counts)
    return e | {"gamma": e["gamma"][0], "concept": e["concept"][0]}


def hmm_estep_many(pi: np.ndarray, init: np.ndarray, trans: np.ndarray, b: np.ndarray, init_counts: str = "all") -> dict:
    """Expected counts of ``pi[B, n, K]`` and ``b[B, T, K]``: gamma[B, T, K] and concept[B, n, K] of each example; init[n], trans[n, n] and the
    log-likelihood of all."""
    many, n, k = pi.shape
    stay, move = np.diag(trans), trans - np.diag(np.diag(trans))
    b = b.transpose(1, 0, 2)[:, :, None]
    f, logs = hmm_forward(pi, init, trans, b)
    beta = np.ones((many, n, k))
    gamma, first, xi = np.zeros((many, len(b), k)), np.zeros(n), np.zeros((n, n))
    for t in range(len(b) - 1, -1, -1):
        g = f[t] * beta
        g /= np.maximum(g.sum((1, 2), keepdims=True), 1e-300)
        gamma[:, t] = g.sum(1)
        if init_counts == "all" or not t:
            first += g.sum((0, 2))
        if t:
            nb = b[t] * beta
            enter = (pi * nb).sum(2)
            step = f[t - 1].sum(2)[:, :, None] * move * enter[:, None]
            step[:, np.arange(n), np.arange(n)] = stay * (f[t - 1] * nb).sum(2)
            xi += (step / np.maximum(step.sum((1, 2), keepdims=True), 1e-300)).sum(0)
            beta = stay[:, None] * nb + (enter @ move.T)[..., None]
            beta = beta / np.maximum(beta.max((1, 2), keepdims=True), 1e-300)
    concept = np.zeros((many, n, k))
    for i in range(n):  # the region held to each concept in turn, all concepts at once
        held = np.repeat(pi[None], k, 0)
        held[:, :, i] = np.eye(k)[:, None]
        _, scales = hmm_forward(held, init, trans, b)
        w = scales.sum(0).T + np.log(np.maximum(pi[:, i], 1e-300))
        concept[:, i] = np.exp(w - log_sum_exp(w)[:, None])
    return {"init": first, "trans": xi, "gamma": gamma, "concept": concept, "loglik": float(logs.sum())}


def hmm_viterbi(pi: np.ndarray, init: np.ndarray, trans: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(region of each position, normalised scores[T, n]); ties take the lowest region."""
    emit = np.maximum(pi @ b.T, 1e-300)
    with np.errstate(divide="ignore"):
        li, lt, le = np.log(init), np.log(trans), np.log(emit)
    score, back, probs = li + le[:, 0], [], []
    for t in range(len(b)):
        if t:
            total = score[:, None] + lt
            back.append(total.argmax(0))
            score = total.max(0) + le[:, t]
        p = np.exp(score - score.max())
        probs.append(p / p.sum())
    path = [int(score.argmax())]
    for p in reversed(back):
        path.append(int(p[path[-1]]))
    return np.array(path[::-1]), np.array(probs)


# Gaussian components with fixed variance: stats n[K], total[K, D]; prior mean mu0[D], variances var, var0.


def component_posterior(n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float) -> tuple[np.ndarray, np.ndarray]:
    """(posterior mean, predictive precision) of every component; an inactive one has the prior's."""
    prec = 1 / var0 + n / var
    mean = (mu0 / var0 + total / var) / prec[:, None]
    pred = prec / var / (prec + 1 / var)
    return np.where(n[:, None] > 0, mean, mu0), np.where(n > 0, pred, 1 / var0)


def log_densities(x: np.ndarray, mean: np.ndarray, prec: np.ndarray) -> np.ndarray:
    """log N(x; mean_k, 1 / prec_k) for all rows and components."""
    d = x.shape[1]
    return 0.5 * d * (np.log(prec) - math.log(2 * math.pi)) - 0.5 * prec * squared_distances(x, mean)


def own_removed(x: np.ndarray, at: np.ndarray, k: np.ndarray, n_own: np.ndarray, own: np.ndarray, n: np.ndarray, total: np.ndarray, mu0: np.ndarray, var: float, var0: float) -> np.ndarray:
    """log density of each row ``x[at]`` under component ``k``, after ``n_own`` vectors that sum to ``own`` are taken out of it."""
    left = n[k] - n_own
    mean, prec = component_posterior(left, total[k] - own, mu0, var, var0)
    d = x.shape[1]
    return 0.5 * d * (np.log(prec) - math.log(2 * math.pi)) - 0.5 * prec * ((x[at] - mean) ** 2).sum(1)


def component_log_prior(n: np.ndarray, alpha: float) -> np.ndarray:
    return np.log(alpha / len(n) + n) - np.log(n.sum() + alpha)


def log_marginal(n: float, total: np.ndarray, squares: np.ndarray, mu0: np.ndarray, var: float, var0: float) -> float:
    """log p(X of one component), its mean integrated out."""
    if not n:
        return 0.0
    prec = 1 / var0 + n / var
    quad = squares / var + mu0**2 / var0 - (mu0 / var0 + total / var) ** 2 / prec
    return float((-0.5 * n * math.log(2 * math.pi * var) - 0.5 * math.log(var0 * prec) - 0.5 * quad).sum())


def dirichlet_log_likelihood(counts: np.ndarray, base: np.ndarray, alpha: float) -> float:
    """log p of draws from a Dirichlet multinomial with concentration ``alpha`` over the base probabilities of the seen words."""
    lg = np.vectorize(math.lgamma)
    return float(math.lgamma(alpha) - math.lgamma(alpha + counts.sum()) + (lg(counts + alpha * base) - lg(alpha * base)).sum())
