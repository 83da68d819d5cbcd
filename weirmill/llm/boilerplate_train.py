"""Training of the page model: python -m weirmill.llm.boilerplate_train SF_DIR

Pages are labelled here by rules with a view of the whole page (a tag tree with repaired nesting for html, wording and runs
for text); the field then learns which local evidence carries a label and how labels follow each other.
"""

from __future__ import annotations

import json
import math
import random
import sys

from weirmill.llm import boilerplate as B

#: Bound of the labelled sample, pages of each kind.
MAX_PAGES = 6000

_SURE = {"skip", "top", "ad", "share", "head", "also", "cookie", "rights", "legal", "owner", "follow", "script", "menu", "bar", "word"}
_BODY = {"sentence", "long", "item", "row"}


def label_text(texts: list[str], title: str = "", tags: list[frozenset[str]] | None = None) -> list[int]:
    """Labels of a page's units by rules."""
    kinds = [B.read_line(t)[0] for t in texts]
    total = len(texts)
    solid = [i for i, k in enumerate(kinds) if k in _BODY]
    last = solid[-1] if solid else -1
    first = solid[0] if solid else total
    plain = [" ".join(B._WORD.findall(t.lower())) for t in texts]
    name = " ".join(B._WORD.findall(title.lower()))
    labels = []
    listing = False
    for i, k in enumerate(kinds):
        if k == "head":
            listing = True
            y = 1
        elif k in _SURE:
            listing = False
            y = 1
        elif k in _BODY:
            if k == "item" and listing and not B._SENTENCE.search(texts[i]):
                y = 1
            else:
                listing = False
                y = 0
        elif k == "mark":
            y = 0 if first < i <= last + 1 else 1
        elif k == "name":
            y = 0 if name and plain[i] == name else 1
        elif i > last and solid:
            y = 1
        elif listing:
            # the list of links goes on while headings follow; before a paragraph its last heading is the text's own
            run_end = i
            while run_end + 1 < total and kinds[run_end + 1] in ("heading", "phrase"):
                run_end += 1
            y = 0 if run_end == i and i + 1 < total and kinds[i + 1] in _BODY and i - 1 >= 0 and kinds[i - 1] != "head" else 1
            if name and plain[i] and plain[i] in name:
                y = 0
            if y == 0:
                listing = False
        else:
            y = 0 if i + 1 < total or not solid else 1
        labels.append(y)
    if tags is not None:
        for i, t in enumerate(tags):
            if t & {"h1", "blockquote", "td", "th"} and kinds[i] not in _SURE and "a" not in t and first - 2 <= i <= last + 1:
                labels[i] = 0
            if t & {"nav", "footer", "aside", "form", "button"} and "p" not in t and kinds[i] != "sentence":
                labels[i] = 1
    return labels


def train(pages: list[tuple[list[tuple], list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> B.Chain:
    """Adagrad on the log-likelihood; gradients by forward-backward."""
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    steps = [[1.0, -1.0], [-1.0, 1.0]]
    step_squares = [[1.0, 1.0], [1.0, 1.0]]
    order = random.Random(seed)
    lse = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    tie = 3.0
    pages = [([B.expand(sign) for sign in units], labels) for units, labels in pages]
    for _ in range(rounds):
        order.shuffle(pages)
        for units, labels in pages:
            n = len(units)
            if not n:
                continue
            x = [sum(weights.get(f, 0.0) for f in fs) for fs in units]
            ties = [tie if fs[-1] == "joined" else 0.0 for fs in units]
            fwd = [(0.0, x[0])]
            for i in range(1, n):
                a, b = fwd[-1]
                fwd.append((lse(a + steps[0][0] + ties[i], b + steps[1][0]), lse(a + steps[0][1], b + steps[1][1] + ties[i]) + x[i]))
            bwd = [(0.0, 0.0)] * n
            for i in range(n - 2, -1, -1):
                a, b = bwd[i + 1]
                b += x[i + 1]
                bwd[i] = (lse(steps[0][0] + ties[i + 1] + a, steps[0][1] + b), lse(steps[1][0] + a, steps[1][1] + ties[i + 1] + b))
            z = lse(*fwd[-1])
            for i in range(n):
                g = labels[i] - math.exp(min(0.0, fwd[i][1] + bwd[i][1] - z))
                if abs(g) > 1e-4:
                    for f in units[i]:
                        if f == "joined":
                            continue
                        q = squares[f] = squares.get(f, 1e-2) + g * g
                        weights[f] = weights.get(f, 0.0) * (1 - decay) + rate * g / math.sqrt(q)
                if i:
                    for p in (0, 1):
                        for c in (0, 1):
                            e = fwd[i - 1][p] + steps[p][c] + (ties[i] if p == c else 0) + (x[i] if c else 0) + bwd[i][c] - z
                            g2 = (labels[i - 1] == p and labels[i] == c) - math.exp(min(0.0, e))
                            step_squares[p][c] += g2 * g2
                            steps[p][c] += 0.1 * rate * g2 / math.sqrt(step_squares[p][c])
    return B.Chain({f: round(w, 3) for f, w in weights.items() if abs(w) > 0.05}, [[round(v, 3) for v in s] for s in steps], tie)


def load(sf_dir: str) -> list[tuple[list[tuple], list[int]]]:
    import pyarrow.parquet as pq

    pages = []
    for r in pq.read_table(f"{sf_dir}/webset_items.parquet", columns=["content", "title"]).to_pylist()[:MAX_PAGES]:
        if r["content"]:
            texts, _ = B.text_units(r["content"])
            pages.append((B.features(texts, r["title"] or ""), label_text(texts, r["title"] or "")))
    for r in pq.read_table(f"{sf_dir}/fetch_results.parquet", columns=["html", "status"]).to_pylist()[:MAX_PAGES]:
        if r["html"] and r["status"] == 200:
            texts, _, tags, joined, title = B.html_units(r["html"])
            pages.append((B.features(texts, title, tags, joined), label_text(texts, title, tags)))
    return pages


def main(sf_dir: str) -> None:
    pages = load(sf_dir)
    held, rest = pages[::10], [p for i, p in enumerate(pages) if i % 10]
    chain = train(rest)
    right = total = 0
    for units, labels in held:
        got = chain.decode(units)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    print(f"held-out agreement {right / total:.4f} of {total} units; {len(chain.weights)} weights; steps {chain.steps}")
    B.MODEL.parent.mkdir(exist_ok=True)
    B.MODEL.write_text(json.dumps({"weights": dict(sorted(chain.weights.items())), "steps": chain.steps, "tie": chain.tie}, ensure_ascii=False, indent=0))


if __name__ == "__main__":
    main(sys.argv[1])
