"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's features describe its own characters and those of the lines
before and after it; a transition score ties the labels of neighbours together. Forward-backward
gives each line's probability to be good, and the mean over a text's lines, weighted by their
length, is the score of the text. Trained in numpy on a bounded sample of labelled documents,
whose lines carry the label of their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, fold, utf8

# kinds of bytes; each is counted for every line
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "stop": b".,;:?'\"-()",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*@^~=+_\\/<>[]{}`",
    "wide": bytes(range(128, 256)),
}
OWN = 21
WIDTH = 3 * OWN + 1


@dataclass(frozen=True)
class Settings:
    """``docs_per_label`` and ``lines_per_doc`` bound the training sample."""

    docs_per_label: int = 700
    lines_per_doc: int = 24
    steps: int = 160
    rate: float = 0.1
    decay: float = 1e-3


@dataclass(frozen=True)
class Field:
    """Weights of the features for good against bad, and 2 x 2 transition scores."""

    weights: np.ndarray
    transitions: np.ndarray


def _kind_of_byte() -> np.ndarray:
    table = np.full(256, len(_KINDS), np.uint8)
    for i, members in enumerate(_KINDS.values()):
        table[list(members)] = i
    return table


_TABLE = _kind_of_byte()
_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
# a word's name is the sum of random numbers of its bytes; blanks add nothing
_NAMES = np.where(_BLANK, 0, np.random.default_rng(3).integers(1, 1 << 62, 256))


def split_lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every line in the bytes, and the first line of every text (one more).

    Lines are what ``\\n`` separates; an empty text has one empty line.
    """
    low, high = int(bounds[0]), int(bounds[-1])
    breaks = np.flatnonzero(data[low:high] == 10) + low
    texts = len(bounds) - 1
    counts = np.searchsorted(breaks, bounds[1:]) - np.searchsorted(breaks, bounds[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    begins, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    is_first, is_last = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    begins[is_first], ends[is_last] = bounds[:texts], bounds[1:]
    begins[~is_first], ends[~is_last] = breaks + 1, breaks
    return begins, ends, first


def _repeated(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Has the same text an equal line before this one?"""
    out = np.zeros(len(begins), np.float32)
    for i in range(len(first) - 1):
        if first[i + 1] - first[i] > 1:
            seen: set[bytes] = set()
            for k in range(first[i], first[i + 1]):
                line = data[begins[k] : ends[k]].tobytes()
                if line in seen:
                    out[k] = 1
                seen.add(line)
    return out


def _words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of every line, and how many of them equal the word before in the line."""
    low, high = int(begins[0]), int(ends[-1])
    if low == high:
        return np.zeros(len(begins)), np.zeros(len(begins))
    part = data[low:high]
    blank = _BLANK[part]
    opens = ~blank
    opens[1:] &= blank[:-1]
    first = begins[begins < ends] - low
    opens[first] = ~blank[first]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(len(begins)), np.zeros(len(begins))
    line = np.searchsorted(begins, starts + low, "right") - 1
    names = np.add.reduceat(_NAMES[part], starts)
    same = (names[1:] == names[:-1]) & (line[1:] == line[:-1])
    return np.bincount(line, minlength=len(begins)), np.bincount(line[1:][same], minlength=len(begins))


def line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line, bytes by line, and the first line of every text (one more).

    The columns: a constant, then the line's own features, the ones of the line before and of
    the line after; zeros where there is none.
    """
    begins, ends, first = split_lines(data, bounds)
    n = len(begins)
    size = (ends - begins).astype(np.float32)
    low = int(bounds[0])
    kinds = _TABLE[data[low : int(bounds[-1])]]
    counts = np.zeros((len(_KINDS), n), np.float32)
    if len(kinds):
        # a line's own range and the break after it; of the last line the text's end
        starts = np.minimum(begins - low, len(kinds) - 1)
        for i in range(len(_KINDS)):
            counts[i] = np.add.reduceat((kinds == i).view(np.uint8), starts, dtype=np.int64)
        counts[:, size == 0] = 0
    share = counts / np.maximum(size, 1)
    names = list(_KINDS)
    upper, lower, bang, bar, sign = (
        share[names.index(k)] for k in ("upper", "lower", "bang", "bar", "sign")
    )
    words, echoes = _words(data, begins, ends)
    at_end = np.where(size > 0, data[np.maximum(ends - 1, low)] if len(kinds) else 0, 0)
    own = np.stack(
        [
            *share,
            np.log1p(size) / 10,
            size == 0,
            size < 30,
            upper > lower,
            bang > 0.02,
            bar > 0.02,
            sign > 0.04,
            np.minimum(size / np.maximum(words, 1), 50) / 10,
            echoes / np.maximum(words, 1),
            echoes > 0.2 * words,
            np.isin(at_end, list(b".!?\"'")),
            _repeated(data, begins, ends, first),
        ]
    ).astype(np.float32)
    table = np.zeros((n, WIDTH), np.float32)
    table[:, 0] = 1
    table[:, 1 : OWN + 1] = own.T
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    has_before[first[:-1]] = False
    has_after[first[1:] - 1] = False
    before, after = np.flatnonzero(has_before), np.flatnonzero(has_after)
    table[before, OWN + 1 : 2 * OWN + 1] = own.T[before - 1]
    table[after, 2 * OWN + 1 :] = own.T[after + 1]
    return table, size, first


def _log_sums(scores: np.ndarray) -> np.ndarray:
    return np.logaddexp(scores[..., 0, :], scores[..., 1, :])


def forward_backward(
    unary: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Chains side by side: ``unary`` is position by chain, the score of good; bad scores 0.

    Returns the probability of good at each position and the log of the sum over all labellings
    of each chain; with a ``weight`` for each chain also the expected number of each transition.
    Positions from ``lengths`` on are void.
    """
    steps, n = unary.shape
    emit = np.zeros((steps, n, 2))
    emit[..., 1] = unary
    ahead = np.empty((steps, n, 2))
    ahead[0] = emit[0]
    live = np.arange(steps)[:, None] < lengths
    for t in range(1, steps):
        move = _log_sums(ahead[t - 1][:, :, None] + transitions)
        ahead[t] = np.where(live[t][:, None], move + emit[t], ahead[t - 1])
    back = np.zeros((steps, n, 2))
    for t in range(steps - 2, -1, -1):
        move = _log_sums(np.swapaxes(transitions + (back[t + 1] + emit[t + 1])[:, None, :], 1, 2))
        back[t] = np.where(live[t + 1][:, None], move, 0)
    total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
    good = np.exp(ahead[..., 1] + back[..., 1] - total)
    expected = None
    if weight is not None:
        later = (back[1:] + emit[1:])[:, :, None, :]
        pairs = np.exp(ahead[:-1, :, :, None] + transitions + later - total[:, None, None])
        expected = (pairs * (live[1:] * weight)[:, :, None, None]).sum(axis=(0, 1))
    return np.clip(good, 0, 1), total, expected


def train(features: list[np.ndarray], labels: np.ndarray, s: Settings) -> Field:
    """Maximum likelihood by Adam; every line of a document carries the document's label."""
    lengths = np.array([len(f) for f in features])
    steps, n = lengths.max(), len(features)
    table = np.zeros((steps, n, WIDTH), np.float32)
    for i, f in enumerate(features):
        table[: len(f), i] = f
    live = np.arange(steps)[:, None] < lengths
    truth = labels.astype(np.float64) * live
    # each label weighs the same, and so does each document
    weight = 1 / np.maximum(np.bincount(labels, minlength=2), 1)[labels] / lengths
    held = np.zeros((2, 2))
    for label in (0, 1):
        held[label, label] = ((lengths - 1) * weight)[labels == label].sum()
    p = [np.zeros(WIDTH), np.zeros((2, 2))]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, s.steps + 1):
        good, _, expected = forward_backward(table @ p[0].astype(np.float32), lengths, p[1], weight)
        gap = ((good * live - truth) * weight).astype(np.float32)
        slope = gap.ravel() @ table.reshape(-1, WIDTH)
        grads = [slope + s.decay * p[0], expected - held + s.decay * p[1]]
        for k, g in enumerate(grads):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            ahead = first[k] / (1 - 0.9**step)
            p[k] = p[k] - s.rate * ahead / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(p[0], p[1])


def scores(field: Field, data: np.ndarray, bounds: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """The score of every text; texts are taken in groups of about ``most`` bytes."""
    out = np.empty(len(bounds) - 1)
    begin = 0
    while begin < len(out):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + most, "right")) - 1)
        table, size, first = line_features(data, bounds[begin : end + 1])
        unary = table @ field.weights
        lengths = np.diff(first)
        # chains of like length side by side: at most half of a block is void
        for power in np.unique(np.ceil(np.log2(lengths))):
            chains = np.flatnonzero(np.ceil(np.log2(lengths)) == power)
            steps = lengths[chains].max()
            at = np.minimum(first[chains] + np.arange(steps)[:, None], first[chains + 1] - 1)
            good = forward_backward(unary[at], lengths[chains], field.transitions)[0]
            weight = (size[at] + 1) * (np.arange(steps)[:, None] < lengths[chains])
            out[begin + chains] = (good * weight).sum(axis=0) / weight.sum(axis=0)
        begin = end
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Field | None:
    """Train on labelled rows of ``docs`` (doc_id, text); ``None`` if a label has no rows.

    The sample: for each of the labels 0 and 1 the ``docs_per_label`` documents that come first
    by a hash of the id, and of each the middle ``lines_per_doc`` lines of its whole text.
    """
    s = settings or Settings()
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")
    )
    known = known.filter("label = other").select("doc_id", "label")
    # at most docs_per_label ids of either label: small by construction
    picked = F.broadcast(first_by_hash(known, "doc_id", "label", s.docs_per_label))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, _, first = line_features(*utf8(batch.column(1)))
            parts = []
            for begin, end in zip(first[:-1], first[1:], strict=True):
                skip = max(0, (end - begin - s.lines_per_doc) // 2)
                parts.append(table[begin + skip : end - skip][: s.lines_per_doc].tobytes())
            columns = [batch.column(0), batch.column(2), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "lines"])

    rows = (
        docs.join(picked, "doc_id")
        .select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("label").cast("int"))
        .mapInArrow(cut, "doc_id bigint, label int, lines binary")
        .collect()
    )
    rows.sort()
    found = np.array([r[1] for r in rows], np.int64)
    if len(np.unique(found)) < 2:
        return None
    return train([np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows], found, s)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Learns from labels of rows that are not held out; a document with both labels teaches
    nothing. Null and empty texts have one empty line. Without both labels to learn from every
    score is 0.5. A null doc_id is held out.
    """
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(True))
    texts = docs.select("doc_id", "text")
    field = fit(texts.filter(~held_out), labels.select("doc_id", "quality").filter(~held_out), settings)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(scores(field, *utf8(column)))

    score = F.lit(0.5) if field is None else scored(F.col("text").cast("string"))
    return texts.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
