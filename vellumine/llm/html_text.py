"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each is read as a vector: its tag path (every step hashed with its names, the
nearest steps once more by their distance), its words hashed, and a few numbers (length, share of link text,
punctuation, place in the page). A bidirectional LSTM in numpy reads the whole sequence both ways, so the label of every
block, main text or not, depends on all of the page.

The labeller is trained when it is first needed, in a task on an executor, on pages that `sample_pages` makes: many
layouts, class names, broken markup and invented words, with menus, headers, footers, sidebars, notices, adverts, forms
and comments. Nothing of the pages to extract is trained on. Its weights are 160 kilobytes; they are kept in the shared
folder, under a name that tells the code which made them, and go to the workers as they are.

Defined results: a null or empty page, or one without main text, has an empty text. Repeated pages come out alike. An
empty table gives no rows. Pages of any length, nesting and brokenness are read whole, in time that grows with their
length; pages of like length are labelled together, `CELLS` blocks at a time, and long ones in slices of time.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import OWN, kept_value
from vellumine.llm.html_blocks import Block, Step, blocks
from vellumine.llm.words import pieces, plain

PATH, NEAR, WORD, NUMBERS = 96, 64, 16, 8
INPUT = PATH + NEAR + WORD + NUMBERS
HIDDEN = 24
#: Blocks that are labelled together, and steps of time for which the gates are worked out at once.
CELLS, SLICE = 16_384, 2048


@lru_cache(maxsize=100_000)
def _place(name: str) -> tuple[int, int]:
    h = zlib.crc32(name.encode())
    return h & 0xFFFF, 1 if h >> 16 & 1 else -1


def _hashed(out: np.ndarray, names: list[str] | tuple[str, ...], weight: float = 1.0) -> None:
    for name in names:
        at, sign = _place(name)
        out[at % len(out)] += sign * weight


def _path_sums(path: Step) -> np.ndarray:
    """Of all names from the root to here; kept with each step."""
    todo = [path]
    while todo[-1].sums is None and todo[-1].above is not None:
        todo.append(todo[-1].above)
    for step in reversed(todo):
        if step.sums is None:
            step.sums = np.zeros(PATH, dtype=np.float32) if step.above is None else step.above.sums.copy()
            _hashed(step.sums, step.names)
    return path.sums


@lru_cache(maxsize=20_000)
def _near(names: tuple[tuple[str, ...], ...]) -> np.ndarray:
    """Of the nearest steps, each name by its distance."""
    out = np.zeros(NEAR, dtype=np.float32)
    for k, step in enumerate(names):
        _hashed(out, [f"{k} {name}" for name in step], 1.0 / (1 + k))
    return out


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), INPUT), dtype=np.float32)
    total = sum(len(b.text) for b in page) or 1
    done = 0
    last: Step | None = None
    for i, b in enumerate(page):
        if b.path is last and i:
            out[i, : PATH + NEAR] = out[i - 1, : PATH + NEAR]
        elif b.path is not None:
            out[i, :PATH] = _path_sums(b.path)
            out[i, PATH : PATH + NEAR] = _near(tuple(step.names for step in b.path.nearest(4)))
            np.clip(out[i, : PATH + NEAR], -3, 3, out=out[i, : PATH + NEAR])
        last = b.path
        n = len(b.text)
        words = b.text.lower().split()
        _hashed(out[i, PATH + NEAR : PATH + NEAR + WORD], words, 1 / math.sqrt(len(words)))
        marks = sum(map(b.text.count, ".,;:!?"))
        out[i, -NUMBERS:] = (math.log1p(n) / 6, b.linked / max(1, n), min(1.0, 10 * marks / max(1, n)), b.text[-1:] in ".!?", i / len(page), done / total, n / total, 1.0)
        done += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Labeller:
    """Two LSTM layers, forwards and backwards, and a logistic output over both."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((INPUT, 4 * h)) / math.sqrt(INPUT)).astype(np.float32)
            self.p["h" + d] = (rng.standard_normal((h, 4 * h)) / math.sqrt(h)).astype(np.float32)
            bias = np.zeros(4 * h, dtype=np.float32)
            bias[h : 2 * h] = 1  # remembers at first
            self.p["c" + d] = bias
        self.p["o"] = (rng.standard_normal((2 * h, 1)) / math.sqrt(2 * h)).astype(np.float32)
        self.p["q"] = np.zeros(1, dtype=np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, page, hidden) of one direction; with what the way back needs."""
        n, pages, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
        out, past = np.zeros((n, pages, HIDDEN), dtype=np.float32), []
        recurrent, full = self.p["h" + d], bool(mask.all())
        slices = range(0, n, SLICE) if d == "f" else range((n - 1) // SLICE * SLICE, -1, -SLICE)
        for lo in slices:
            gates = x[lo : lo + SLICE] @ self.p["x" + d] + self.p["c" + d]
            m = len(gates)
            for k in range(m) if d == "f" else range(m - 1, -1, -1):
                t = lo + k
                g = gates[k] + h @ recurrent
                ifo = _sigmoid(g[:, : 3 * HIDDEN])
                i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
                u = np.tanh(g[:, 3 * HIDDEN :])
                new = f * c + i * u
                tanh = np.tanh(new)
                live = mask[t][:, None]
                if keep:
                    past.append((t, i, f, o, u, c, tanh, h, live))
                c = new if full else np.where(live, new, c)
                h = o * tanh if full else np.where(live, o * tanh, h)
                out[t] = h
        return out, past

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return (both @ self.p["o"] + self.p["q"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        z = (both @ self.p["o"] + self.p["q"])[..., 0]
        p = _sigmoid(z)
        n = mask.sum()
        dz = np.where(mask, p - y, 0)[..., None] / n
        loss = float(-np.sum(np.where(mask, y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9), 0)) / n)
        grad = {"o": np.einsum("tph,tpo->ho", both, dz), "q": dz.sum((0, 1))}
        down = dz @ self.p["o"].T
        for k, d in enumerate("fb"):
            dout = down[..., k * HIDDEN : (k + 1) * HIDDEN]
            gx, gh, gc = (np.zeros_like(self.p[a + d]) for a in "xhc")
            dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
            for t, i, f, o, u, c, tanh, h, m in reversed(runs[d][1]):
                dh = dh + dout[t]
                live = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + live * o * (1 - tanh**2)
                dg = np.concatenate([dnew * u * i * (1 - i), dnew * c * f * (1 - f), live * tanh * o * (1 - o), dnew * i * (1 - u**2)], axis=1)
                gx += x[t].T @ dg
                gh += h.T @ dg
                gc += dg.sum(0)
                dc = np.where(m, dnew * f, dc)
                dh = np.where(m, dg @ self.p["h" + d].T, dh)
            grad |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return loss, grad

    def label(self, pages: list[np.ndarray], cells: int = CELLS) -> list[np.ndarray]:
        """Which blocks are main text. Pages of like length go together as long as they have at most so many cells, blocks and padding."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop()]  # the longest left
            while order and (len(some) + 1) * len(pages[some[0]]) <= cells:
                some.append(order.pop())
            x, mask = padded([pages[i] for i in some])
            hot = self.logits(x, mask) > 0
            for k, i in enumerate(some):
                out[i] = hot[: len(pages[i]), k]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x, mask = np.zeros((n, len(pages), INPUT), dtype=np.float32), np.zeros((n, len(pages)), dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


def train(pages: int = 2000, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Labeller:
    """A labeller trained on pages that are made for it."""
    from vellumine.llm.html_samples import sample_pages

    rng = np.random.default_rng(seed)
    examples = []
    for page, main in sample_pages(pages, seed):
        found = blocks(page)
        if found:
            examples.append((vectors(found), np.array([b.text in main for b in found], dtype=np.float32)))
    model = Labeller()
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples)).tolist()
        order = [i for lo in range(0, len(order), 5 * batch) for i in sorted(order[lo : lo + 5 * batch], key=lambda i: len(examples[i][0]))]
        for lo in range(0, len(order), batch):
            some = [examples[i] for i in order[lo : lo + batch]]
            x, mask = padded([v for v, _ in some])
            y = np.zeros(mask.shape, dtype=np.float32)
            for k, (_, t) in enumerate(some):
                y[: len(t), k] = t
            _, grad = model.gradients(x, mask, y)
            size = math.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            step += 1
            now = rate * (1 - 0.8 * epoch / epochs)
            for k, g in grad.items():  # Adam, with clipped gradients
                g = g * min(1, 1 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                model.p[k] = (model.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


@cache
def _made_by() -> str:
    """Tells the code that trains apart."""
    files = [Path(__file__).with_name(name) for name in ("html_text.py", "html_blocks.py", "html_samples.py")]
    return f"{zlib.crc32(b''.join(f.read_bytes() for f in files)):08x}"


def trained(spark: SparkSession) -> Labeller:
    """The labeller, trained once for a shared folder: in one task, of a size that doesn't depend on any input."""
    out = Labeller()
    out.p = kept_value(spark, f"html-labeller-{_made_by()}", lambda: pickle.dumps(train().p), pickle.loads)
    return out


def main_texts(pages: list[str], model: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    labels = model.label([vectors(b) for b in found])
    return [" ".join(b.text for b, y in zip(f, hot, strict=True) if y) for f, hot in zip(found, labels, strict=True)]


def extract(pages: DataFrame, model: Labeller | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """keep..., out for each page."""
    sent = pages.sparkSession.sparkContext.broadcast((model or trained(pages.sparkSession)).p)  # of one size, whatever the input
    rows = pages.select(*keep, F.col(html).cast("string").alias(OWN + "html"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = sent.value
        for batch in batches:
            html_ = plain(batch.column(OWN + "html"))
            for lo, hi in pieces(html_):  # about as much text at a time, however many pages that is
                part = batch.slice(lo, hi - lo)
                texts = main_texts(html_.slice(lo, hi - lo).to_pylist(), own)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, out])

    return rows.mapInArrow(run, schema)
