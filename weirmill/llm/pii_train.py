"""Training of the span scorer: python -m weirmill.llm.pii_train SF_DIR

Candidates of a bounded sample of documents are labelled by rules that see the whole format and wording of a span; boosted
trees are fitted to them by logistic loss, and each kind's threshold is calibrated on held-out documents for the best F1.
"""

from __future__ import annotations

import json
import sys

import numpy as np

from weirmill.llm import pii as P

#: Bound of the labelled sample, in documents.
MAX_DOCUMENTS = 10_000


def label(kind: str, f: dict[str, float]) -> int:
    g = lambda k: f.get(k, 0)
    if kind == "email":
        return int(not g("file_end") and g("domain_parts") >= 2)
    if kind == "phone":
        if g("in_email") or g("not_cue") or g("shape") not in (1, 2, 3, 4):
            return 0
        return int(not g("other_cue") or g("cue") or g("after_cue"))
    if kind == "id_number":
        if g("in_email") or g("shape") == -1:
            return 0
        if not (g("cue") or g("after_cue")):
            return 0
        if g("shape") in (1, 2, 3, 4) and (g("other_cue") or not g("cue")):
            return 0
        return int(g("shape") in (5, 6, 7, 8) or g("digits") >= 8)
    if kind == "address":
        return int(g("digits") >= 1 and not g("company_next"))
    if g("in_email") or g("in_address") or g("company_next") or g("amp") or g("number_before"):
        return 0
    if g("n") >= 2 and g("family") >= 1 and g("given") >= 1 and (g("order") or (g("reverse"))):
        if g("plain") >= g("n") and not (g("title_before") or g("role_cue")):
            return 0
        if g("case") == 0 and not (g("title_before") or g("role_cue") or g("listed") or g("at_line_start")):
            return 0
        return 1
    return int(g("initial") and g("family") >= 1 and not g("file_end") and g("case") > 0 and not (g("plain") >= g("n") and not (g("title_before") or g("role_cue"))))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: float = 8.0, ridge: float = 1.0):
    """One regression tree on the gradients, by exact search over each feature's cuts."""
    total_g, total_h = grad.sum(), hess.sum()
    leaf = round(float(0.6 * total_g / (total_h + ridge)), 4)
    if depth == 0 or len(grad) < 2 * least:
        return leaf
    best, where = total_g**2 / (total_h + ridge) + 1e-6, None
    for j, values in enumerate(cuts):
        for c in values:
            left = x[:, j] <= c
            n = int(left.sum())
            if n < least or len(left) - n < least:
                continue
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl**2 / (hl + ridge) + (total_g - gl) ** 2 / (total_h - hl + ridge)
            if gain > best + 1e-3:
                best, where = gain, (j, float(c), left)
    if where is None:
        return leaf
    j, c, left = where
    return [j, c, grow(x[left], grad[left], hess[left], cuts, depth - 1, least, ridge), grow(x[~left], grad[~left], hess[~left], cuts, depth - 1, least, ridge)]


def apply(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, list):
        return np.full(len(x), node)
    left = x[:, node[0]] <= node[1]
    out = np.empty(len(x))
    out[left], out[~left] = apply(node[2], x[left]), apply(node[3], x[~left])
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 6) -> tuple[float, list]:
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= 16 else np.quantile(middle, np.linspace(0, 1, 16)))
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, y - p, p * (1 - p), cuts, depth)
        trees.append(tree)
        score += apply(tree, x)
    return base, trees


def main(sf_dir: str) -> None:
    import pyarrow.parquet as pq

    names = pq.read_table(f"{sf_dir}/known_names.parquet").to_pylist()
    words = P.Words([(r["name_word"], r["role"]) for r in names])
    texts = list(dict.fromkeys(pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:MAX_DOCUMENTS]))
    rows = [(i, k, P.vector(k, f), label(k, f)) for i, t in enumerate(texts) for k, _, _, f in P.candidates(t or "", words)]
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    held = np.array([r[0] % 5 == 0 for r in rows])
    base, trees = train(x[~held], y[~held])
    score = base + sum(apply(t, x) for t in trees)
    thresholds = {}
    for k, kind in enumerate(P.KINDS):
        own = held & (x[:, 0] == k)
        best = (-1.0, 0.0)
        for c in np.linspace(-2, 2, 41):
            hit = score[own] >= c
            tp = (hit & (y[own] == 1)).sum()
            f1 = 2 * tp / max(1, hit.sum() + y[own].sum())
            best = max(best, (round(float(f1), 5), -abs(round(float(c), 2)), round(float(c), 2)))
        thresholds[kind] = best[2] if len(best) > 2 else 0.0
        print(kind, "held-out candidates", int(own.sum()), "true", int(y[own].sum()), "F1", best[0], "threshold", thresholds[kind])
    P.MODEL.parent.mkdir(exist_ok=True)
    P.MODEL.write_text(json.dumps({"base": round(base, 4), "trees": trees, "thresholds": thresholds}))


if __name__ == "__main__":
    main(sys.argv[1])
