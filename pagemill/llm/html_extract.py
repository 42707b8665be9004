"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Each block has features from its ancestors (tags, and words in their class, id,
role and label attributes), its text and its place. The field has two labels,
main and other; its weights are fitted to labelled pages by maximum likelihood
(forward-backward gradients), and Viterbi decodes each page.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, in_slices, small_batches, widened
from .html_blocks import GROUPS, KNOWN, MAYBE, Block, Node, blocks
from .html_training import MAIN, OTHER, labelled_pages

#: Parameters of the fit: labelled pages, steps, step size and the weights' prior.
PAGES, STEPS, RATE, PRIOR = 600, 150, 0.2, 1e-4
TAGS = sorted(KNOWN - {"html", "body"})
LENGTHS, LINKS = (3, 10, 25, 60), (0.01, 0.34, 0.67)
NAMES = (
    [f"in {t}" for t in TAGS]
    + [f"leaf {t}" for t in TAGS]
    + [f"says {g}" for g in [*GROUPS, "hidden"]]
    + [f"{where} hints {g}" for where in ("leaf", "above") for g in GROUPS]
    + ["article or main", "no article or main", "clean", "clean in article", "heading in core", "noise in core", "bare body"]
    + [f"words up to {n}" for n in LENGTHS]
    + [f"links from {x}" for x in LINKS]
    + ["ends a sentence", "copyright", "separators", "after h1", "first tenth", "last tenth", "article elsewhere", "bias"]
)
INDEX = {name: i for i, name in enumerate(NAMES)}
AWAY = ("menu", "advert", "comment", "side", "foot", "notice", "share", "form", "hidden")
AWAY_TAGS = frozenset("nav footer aside form dialog button".split())


@lru_cache(maxsize=20_000)
def path_features(tags: frozenset[str], says: frozenset[str], hints: frozenset[str], above: frozenset[str], leaf: str) -> tuple[int, ...]:
    """What a block's ancestors tell."""
    core = bool(tags & {"article", "main"})
    noise = bool(tags & AWAY_TAGS or says & set(AWAY)) or ("head" in says and not core) or "header" in tags
    out = [f"in {t}" for t in TAGS if t in tags] + [f"says {g}" for g in says] + [f"leaf hints {g}" for g in hints] + [f"above hints {g}" for g in above]
    if leaf in TAGS:
        out.append(f"leaf {leaf}")
    out.append("article or main" if core else "no article or main")
    if not noise:
        out += ["clean"] + ["clean in article"] * core
    if core and leaf in ("h1", "h2", "h3") and not (tags & AWAY_TAGS or says & set(AWAY)):
        out.append("heading in core")
    if core and noise:
        out.append("noise in core")
    if not tags - {"html", "body", leaf}:
        out.append("bare body")
    return tuple(INDEX[x] for x in out)


def in_core(node: Node) -> bool:
    return bool({"article", "main"} & node.tags)


def features(page: list[Block]) -> np.ndarray:
    """Blocks x features, 0 or 1."""
    x = np.zeros((len(page), len(NAMES)), dtype=np.float32)
    core = any(in_core(b.node) for b in page)
    h1 = False
    for i, b in enumerate(page):
        at = b.node
        on = list(path_features(at.tags, at.says, at.hints, at.above, at.tag or "body"))
        words = b.text.count(" ") + 1
        on += [INDEX[f"words up to {n}"] for n in LENGTHS if words <= n]
        on += [INDEX[f"links from {s}"] for s in LINKS if b.linked >= s * len(b.text)]
        end = b.text[-1]
        on += [INDEX["bias"]] + [INDEX["ends a sentence"]] * (end in ".!?…。！？") + [INDEX["copyright"]] * ("©" in b.text[:40]) + [INDEX["separators"]] * (" | " in b.text or " · " in b.text)
        on += [INDEX["after h1"]] * h1 + [INDEX["first tenth"]] * (10 * i < len(page)) + [INDEX["last tenth"]] * (10 * (i + 1) > 9 * len(page))
        if core and not in_core(at):
            on.append(INDEX["article elsewhere"])
        h1 = h1 or at.tag == "h1"
        x[i, on] = 1
    return x


class Field:
    """Weights of the features for main against other, of the transitions, and of the first label."""

    def __init__(self, n: int) -> None:
        self.w, self.trans, self.start = np.zeros(n), np.zeros((2, 2)), np.zeros(2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels; ties go to other."""
        if not len(x):
            return np.zeros(0, dtype=int)
        main = (x @ self.w).tolist()
        (oo, om), (mo, mm) = self.trans.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + main[0]
        back = []
        for e in main[1:]:
            from_o, from_m = (a >= b + mo - oo), (a + om >= b + mm)
            back.append((0 if from_o else 1, 0 if from_m else 1))
            a, b = (a + oo if from_o else b + mo), (a + om if from_m else b + mm) + e
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return np.array(out[::-1])

    def gradient(self, x: np.ndarray, y: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log likelihood's gradients for w, trans and start. x: the blocks of all pages x features; y and seen: pages x blocks, padded."""
        pages, length = y.shape
        e = np.zeros((pages, length))
        e[seen] = x @ self.w.astype(np.float32)
        (oo, om), (mo, mm) = self.trans
        ao, am, bo, bm = (np.zeros((pages, length)) for _ in range(4))
        ao[:, 0], am[:, 0] = self.start[0], self.start[1] + e[:, 0]
        for t in range(1, length):
            o, m, on = ao[:, t - 1], am[:, t - 1], seen[:, t]
            ao[:, t] = np.where(on, np.logaddexp(o + oo, m + mo), o)
            am[:, t] = np.where(on, np.logaddexp(o + om, m + mm) + e[:, t], m)
        for t in range(length - 2, -1, -1):
            o, m, on = bo[:, t + 1], bm[:, t + 1] + e[:, t + 1], seen[:, t + 1]
            bo[:, t] = np.where(on, np.logaddexp(oo + o, om + m), bo[:, t + 1])
            bm[:, t] = np.where(on, np.logaddexp(mo + o, mm + m), bm[:, t + 1])
        z = np.logaddexp(ao[:, -1], am[:, -1])[:, None]
        p = np.exp(am + bm - z)
        g = x.T @ (y - p)[seen].astype(np.float32)
        on, into = seen[:, 1:], (bo[:, 1:], bm[:, 1:] + e[:, 1:])
        gt = np.zeros((2, 2))
        for i, alpha in enumerate((ao, am)):
            for j in range(2):
                was = (y[:, :-1] == i) & (y[:, 1:] == j)
                gt[i, j] = (was - np.exp(alpha[:, :-1] + self.trans[i, j] + into[j] - z))[on].sum()
        first = y[:, 0].sum() - p[:, 0].sum()
        return g, gt, np.array([-first, first])


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page whose texts carry MAIN or OTHER."""
    page = blocks(html)
    y = np.array([MAIN in b.text for b in page], dtype=float)
    for b in page:
        b.text = b.text.replace(MAIN, "").replace(OTHER, "") or "x"
    return features(page), y


def fit(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = RATE, prior: float = PRIOR) -> Field:
    """The field of greatest likelihood, by gradient steps with momentum scaled by the gradients' size (Adam)."""
    pages = [p for p in pages if len(p[1]) > 1]
    length = max(len(y) for _, y in pages)
    x = np.concatenate([a for a, _ in pages])
    y, seen = np.zeros((len(pages), length)), np.zeros((len(pages), length), dtype=bool)
    for i, (_, b) in enumerate(pages):
        y[i, : len(b)], seen[i, : len(b)] = b, True
    field = Field(len(NAMES))
    theta, m, v = np.zeros(len(NAMES) + 6), 0.0, 0.0
    for step in range(1, steps + 1):
        field.w, field.trans, field.start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        g, gt, gs = field.gradient(x, y, seen)
        grad = np.concatenate((g, gt.reshape(-1), gs)) / seen.sum() - prior * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.w, field.trans, field.start = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
    return field


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field fitted to the generated labelled pages; made once in the driver."""
    return fit([labelled(html) for html in labelled_pages(PAGES)])


def main_text(field: Field, html: str | None) -> str:
    """The main blocks joined by line ends."""
    page = blocks(html or "")
    keep = field.decode(features(page))
    return "\n".join(b.text for b, main in zip(page, keep, strict=True) if main)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """pages with the columns main_text and n_chars (its code points), one row for each row of pages.

    A null or empty html, and a page without main blocks, has an empty text. Broken
    markup is read as browsers read it as far as blocks go: unclosed elements
    end with their parents, unknown ones count as blocks, ends without a begin
    are ignored, and a tag that the page's end cuts off is dropped; the time is
    linear in the page. All columns of pages
    (with html) stay; where pages has a column of a new one's name, the new one's
    is lengthened by underscores (common.fresh).
    """
    added = fresh(pages.columns, "main_text", "n_chars")
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    at, names, schema = pages.columns.index("html"), [*pages.columns, *added], widened(pages, added, "string", "long")

    def run(batches):
        for whole in batches:
            for b in in_slices(whole, at):
                texts = [main_text(shared.value, x.as_py()) for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return small_batches(pages).mapInArrow(run, schema)
