"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``window`` bytes that together hold all of it. Both directions run
over every window, each position gets a probability for every language, and the mean over all
positions of a text is its score. Training is backpropagation through time in numpy, on a bounded
sample of windows; the network is a few kilobytes and travels with the task.

Arrays are laid out feature by window, so that every gate is one contiguous block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, fold, fresh, utf8

UNKNOWN = "und"
PAD = 256
RESULT = "lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    """``docs_per_language`` and ``windows_per_doc`` bound the training sample."""

    hidden: int = 8
    window: int = 64
    docs_per_language: int = 400
    windows_per_doc: int = 6
    steps: int = 450
    batch: int = 192
    rate: float = 0.02
    seed: int = 7


@dataclass(frozen=True)
class Network:
    """Gate tables by byte (3H x 257), recurrent weights (3H x H) for both directions, output."""

    languages: tuple[str, ...]
    window: int
    weights: dict[str, np.ndarray]


def _start(hidden: int, languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p: dict[str, np.ndarray] = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.3, (3 * hidden, PAD + 1))
        p[f"u{side}"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        p[f"v{side}"] = rng.normal(0, 0.3, (languages, hidden))
    p["c"] = np.zeros((languages, 1))
    p = {k: v.astype(np.float32) for k, v in p.items()}
    for side in "fb":
        _keep_state_on_pad(p[f"x{side}"])
    return p


def _keep_state_on_pad(table: np.ndarray) -> None:
    hidden = len(table) // 3
    table[:, PAD] = 0
    table[:hidden, PAD] = 30  # an update gate of one: the state passes unchanged


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(table, u, symbols, h):
    """One position: gates z, r and candidate n; returns them with the new state."""
    hidden = len(h)
    x = table.take(symbols, axis=1)
    a = u @ h
    zr = x[: 2 * hidden]
    zr += a[: 2 * hidden]
    _sigmoid(zr)
    n = x[2 * hidden :]
    n += zr[hidden:] * a[2 * hidden :]
    np.tanh(n, out=n)
    new = h - n
    new *= zr[:hidden]
    new += n
    return new, zr, n, a[2 * hidden :]


def _probabilities(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def _gradients(p, windows, truth):
    """Cross entropy at every position that is not padding, and its gradients."""
    steps, n = windows.shape
    hidden = p["uf"].shape[1]
    runs = {}
    for side in "fb":
        h = np.zeros((hidden, n), np.float32)
        run = []
        for t in range(steps) if side == "f" else reversed(range(steps)):
            new, zr, cand, un = _step(p[f"x{side}"], p[f"u{side}"], windows[t], h)
            run.append((t, h, new, zr, cand, un))
            h = new
        runs[side] = run
    real = windows != PAD
    total = max(1, int(real.sum()))
    states = {side: {t: new for t, _, new, *_ in run} for side, run in runs.items()}
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    into = {"f": {}, "b": {}}
    columns = np.arange(n)
    loss = 0.0
    for t in range(steps):
        d = _probabilities(p["vf"] @ states["f"][t] + p["vb"] @ states["b"][t] + p["c"])
        loss -= float(np.log(d[truth, columns] + 1e-9)[real[t]].sum())
        d[truth, columns] -= 1
        d *= real[t] / np.float32(total)
        grads["c"] += d.sum(axis=1, keepdims=True)
        for side in "fb":
            grads[f"v{side}"] += d @ states[side][t].T
            into[side][t] = p[f"v{side}"].T @ d
    for side in "fb":
        u, carried = p[f"u{side}"], np.zeros((hidden, n), np.float32)
        by_step = np.empty((steps, 3 * hidden, n), np.float32)
        for t, before, _, zr, cand, un in reversed(runs[side]):
            d = carried + into[side][t]
            z, r = zr[:hidden], zr[hidden:]
            dn = d * (1 - z) * (1 - cand * cand)
            gates = by_step[t]
            gates[:hidden] = d * (before - cand) * z * (1 - z)
            gates[hidden : 2 * hidden] = dn * un * r * (1 - r)
            gates[2 * hidden :] = dn
            pre = gates.copy()
            pre[2 * hidden :] *= r
            grads[f"u{side}"] += pre @ before.T
            carried = d * z + u.T @ pre
        flat = windows.ravel()
        for row, values in zip(grads[f"x{side}"], by_step.transpose(1, 0, 2), strict=True):
            row += np.bincount(flat, values.ravel(), PAD + 1).astype(np.float32)
        grads[f"x{side}"][:, PAD] = 0
    return loss / total, grads


def train(windows: np.ndarray, truth: np.ndarray, languages: tuple[str, ...], s: Settings) -> Network:
    """Adam over random batches. ``windows``: position by window; ``truth``: index of a language."""
    rng = np.random.default_rng(s.seed)
    p = _start(s.hidden, len(languages), rng)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, s.steps + 1):
        pick = rng.integers(0, len(truth), s.batch)
        _, grads = _gradients(p, windows[:, pick], truth[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 1.0 / (size + 1e-9))
        rate = s.rate * min(1.0, 2.0 * (1 - (step - 1) / s.steps))
        for k, g in grads.items():
            g *= shrink
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            ahead = first[k] / (1 - 0.9**step)
            p[k] -= rate * ahead / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return Network(languages, s.window, p)


def _windows(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in windows (position by window), and the text of each window."""
    lengths = np.diff(bounds)
    counts = -(-lengths // width)
    flat = np.full(int(counts.sum()) * width, PAD, np.int16)
    at = 0
    for i, count in enumerate(counts):
        flat[at : at + lengths[i]] = data[bounds[i] : bounds[i + 1]]
        at += count * width
    return flat.reshape(-1, width).T, np.repeat(np.arange(len(counts)), counts)


def _pool(net: Network, windows: np.ndarray) -> np.ndarray:
    """Sums of position probabilities, language by window."""
    p, (steps, n) = net.weights, windows.shape
    hidden = p["uf"].shape[1]
    logits = np.empty((steps, len(net.languages), n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in range(steps):
        h = _step(p["xf"], p["uf"], windows[t], h)[0]
        np.matmul(p["vf"], h, out=logits[t])
    total = np.zeros((len(net.languages), n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in reversed(range(steps)):
        h = _step(p["xb"], p["ub"], windows[t], h)[0]
        at = logits[t]
        at += p["vb"] @ h
        at += p["c"]
        probs = _probabilities(at)
        probs *= windows[t] != PAD
        total += probs
    return total


def document_probabilities(
    net: Network, data: np.ndarray, bounds: np.ndarray, block: int = 4096, most: int = 1 << 22
) -> np.ndarray:
    """Mean position probabilities, text by language; zeros for empty texts.

    Texts are taken in groups of about ``most`` bytes and ``block`` windows at a time.
    """
    out = np.zeros((len(bounds) - 1, len(net.languages)))
    begin = 0
    while begin < len(out):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, "right")) - 1)
        windows, owner = _windows(data, bounds[begin : end + 1], net.window)
        for i in range(0, len(owner), block):
            sums = _pool(net, np.ascontiguousarray(windows[:, i : i + block]))
            for j, row in enumerate(sums):
                out[begin:end, j] += np.bincount(owner[i : i + block], row, end - begin)
        begin = end
    return out / np.maximum(np.diff(bounds), 1)[:, None]


def fit(docs: DataFrame, settings: Settings | None = None, text: str = "text", lang: str = "lang",
        key: str = "doc_id") -> Network | None:
    """Train on windows of the rows with text and language; ``None`` if there are none.

    The sample: for each language the ``docs_per_language`` rows that come first by a hash of
    the key, and of each ``windows_per_doc`` windows spread over its whole text.
    """
    s = settings or Settings()
    known = docs.filter(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull())
    picked = first_by_hash(known.select(key, lang).distinct(), key, lang, s.docs_per_language)
    spread, width = s.windows_per_doc, s.window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(0))
            names, langs, pieces = batch.column(1).to_pylist(), [], []
            for i, name in enumerate(names):
                starts = range(bounds[i], bounds[i + 1], width)
                for k in {len(starts) * (2 * j + 1) // (2 * spread) for j in range(spread)}:
                    langs.append(name)
                    pieces.append(data[starts[k] : min(starts[k] + width, bounds[i + 1])].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(pieces, pa.binary())], ["lang", "piece"]
            )

    # at most docs_per_language ids of each language: small by construction
    rows = (
        known.join(F.broadcast(picked), [key, lang], "left_semi")
        .select(F.col(text).cast("string"), F.col(lang).cast("string"))
        .mapInArrow(cut, "lang string, piece binary")
        .collect()
    )
    if not rows:
        return None
    rows.sort()
    languages = tuple(sorted({r[0] for r in rows}))
    index = {name: i for i, name in enumerate(languages)}
    windows = np.full((width, len(rows)), PAD, np.int16)
    for i, (_, piece) in enumerate(rows):
        windows[: len(piece), i] = np.frombuffer(piece, np.uint8)
    return train(windows, np.array([index[r[0]] for r in rows]), languages, s)


def predict(docs: DataFrame, net: Network | None, text: str = "text", result: str = "language") -> DataFrame:
    """``docs`` with a struct column ``result`` of ``lang_pred`` and ``score`` (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there
    was nothing to learn from. Ties go to the language first by name. Rows, their number and all
    other columns stay as they are.
    """
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return docs.withColumn(result, nothing)

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            probs = document_probabilities(net, *utf8(texts))
            best = probs.argmax(axis=1)
            names = pa.array([net.languages[i] for i in best], pa.string())
            score = pa.array(np.clip(probs[np.arange(len(best)), best], 0, 1))
            yield pa.StructArray.from_arrays([names, score], ["lang_pred", "score"])

    raw = fresh(docs, "scored")
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return (
        docs.withColumn(raw, scored(F.col(text)))
        .withColumn(result, F.when(letters, F.col(raw)).otherwise(nothing))
        .drop(raw)
    )


def identify(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from the rows not held out.

    A null ``doc_id`` is in no fold: it is scored, not learned from, and ``held_out`` is true.
    """
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    net = fit(docs.filter(~held_out).select("doc_id", "text", "lang"), settings)
    out = predict(docs.select("doc_id", "text"), net, result="language")
    return out.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def accepted(docs: DataFrame, min_score: float = 0.4, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` in a language that was recognised with ``min_score`` or more."""
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    net = fit(docs.filter(~held_out).select("doc_id", "text", "lang"), settings)
    column = fresh(docs, "language")
    found = F.col(column)
    kept = (found["lang_pred"] != UNKNOWN) & (found["score"] >= min_score)
    return predict(docs, net, result=column).filter(kept).select(*docs.columns)
