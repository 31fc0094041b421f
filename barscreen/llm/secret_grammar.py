"""Secrets by fixed patterns and by automata inferred from what the patterns find.

The matches of the fixed patterns are labelled credentials. A prefix tree of the credentials of
one kind is reduced by merging states whose outgoing frequencies can't be told apart (Hoeffding
bound); the outcome is a probabilistic automaton of that format. Another one is inferred from
ordinary long words. Every other long run of credential characters is scored by the log
likelihood ratio of the best format against ordinary words.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import first_by_hash

KINDS = ("assign", "access", "hex")
LEARNED = "learned"
ORDINARY = ("word", "number")  # runs without and with digits
_KEYWORDS = ("passw", "secret", "token", "api")
_ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGIT = re.compile("[0-9]")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_ALPHABET = 67  # characters of a run
RESULT = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_learned bigint"
)


@dataclass(frozen=True)
class Settings:
    """``per_kind``: distinct strings of each kind to learn from; ``per_ordinary``: other runs,
    with digits and without;
    ``alpha``: of the Hoeffding test.

    ``ratio``: a run is a secret if its format is at least e**ratio times as likely as a word,
    and if it fits the format as well as the strings do that it was learned from.
    """

    per_kind: int = 300
    per_ordinary: int = 1500
    alpha: float = 0.01
    ratio: float = 12.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, sorted."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def _value(text: str, span: tuple[int, int, int]) -> str:
    """The credential in a base span."""
    start, kind, end = span
    return _ASSIGN.fullmatch(text, start, end)[2] if kind == 0 else text[start:end]


def runs(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Long runs of credential characters that touch no base span, without punctuation around."""
    at = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        if any(s < end and start < e for s, _, e in spans[at:_until(spans, at, end)]):
            continue
        run = m[0]
        start += len(run) - len(run.lstrip("._-/+="))
        end -= len(run) - len(run.rstrip("._-/"))
        if end - start >= 12:
            yield start, end


def _until(spans: list[tuple[int, int, int]], at: int, end: int) -> int:
    while at < len(spans) and spans[at][0] < end:
        at += 1
    return at


@dataclass
class _State:
    count: int = 0
    ends: int = 0
    to: dict[str, int] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic deterministic automaton, inferred from strings by state merging.

    Moves that fewer than ``support`` strings took are forgotten, lest a rare one be learned by
    heart.
    """

    def __init__(self, strings: list[str], alpha: float, support: int = 1) -> None:
        self.support = support
        self.states = [_State()]
        for s in strings:
            self._add(s)
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._reduce()
        self.moves, self.stops = self._compiled()
        # the worst mean fit of a character among the strings
        self.least = min(self.log_likelihood(s) / (len(s) + 1) for s in strings) - 0.1

    def _add(self, s: str) -> None:
        state = self.states[0]
        state.count += 1
        for c in s:
            if c not in state.to:
                state.to[c] = len(self.states)
                self.states.append(_State())
            state.taken[c] = state.taken.get(c, 0) + 1
            state = self.states[state.to[c]]
            state.count += 1
        state.ends += 1

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        """Are the frequencies alike, here and after every common way on?"""
        todo = [(a, b)]
        while todo:
            x, y = (self.states[i] for i in todo.pop())
            if self._differ(x.ends, x.count, y.ends, y.count):
                return False
            for c in x.taken.keys() | y.taken.keys():
                if self._differ(x.taken.get(c, 0), x.count, y.taken.get(c, 0), y.count):
                    return False
                if c in x.to and c in y.to and x.to[c] != y.to[c]:
                    todo.append((x.to[c], y.to[c]))
        return True

    def _likelihood(self, red: int, blue: int) -> float:
        """How well a red state foretells what happened at a blue one."""
        r, b = self.states[red], self.states[blue]
        total = b.ends * math.log((r.ends + 0.1) / (r.count + 0.1 * _ALPHABET))
        for c, n in b.taken.items():
            total += n * math.log((r.taken.get(c, 0) + 0.1) / (r.count + 0.1 * _ALPHABET))
        return total

    def _fold(self, into: int, part: int) -> None:
        """Add a subtree to a state and what follows it."""
        todo = [(into, part)]
        while todo:
            i, j = todo.pop()
            x, y = self.states[i], self.states[j]
            x.count += y.count
            x.ends += y.ends
            for c, n in y.taken.items():
                x.taken[c] = x.taken.get(c, 0) + n
                if c in x.to:
                    todo.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def _reduce(self) -> None:
        """Red states are kept; each state next to them is merged into the best red one or kept."""
        red, seen = [0], {0}
        todo = deque((0, c) for c in sorted(self.states[0].to))
        while todo:
            parent, c = todo.popleft()
            blue = self.states[parent].to[c]
            if blue in seen:
                continue
            fitting = [r for r in red if self._compatible(r, blue)]
            if fitting:
                best = max(fitting, key=lambda r: (self._likelihood(r, blue), -r))
                self.states[parent].to[c] = best
                before = {r: set(self.states[r].to) for r in red}
                self._fold(best, blue)
                todo.extend((r, s) for r in red for s in sorted(set(self.states[r].to) - before[r]))
            else:
                red.append(blue)
                seen.add(blue)
                todo.extend((blue, s) for s in sorted(self.states[blue].to))
        self.kept = red

    def _compiled(self):
        number = {s: i for i, s in enumerate(self.kept)}
        moves, stops = [], []
        for s in self.kept:
            state = self.states[s]
            total = state.count + 0.05 * (_ALPHABET + 1)
            moves.append(
                {
                    c: (number[state.to[c]], math.log((n + 0.05) / total))
                    for c, n in state.taken.items()
                    if n >= self.support
                }
            )
            stops.append(math.log((state.ends + 0.05) / total))
        del self.states
        return moves, stops

    def log_likelihood(self, s: str, least: float = -math.inf) -> float:
        """Of the string and its end; an unseen character costs a fixed amount and stays put.

        Gives up with minus infinity below ``least``.
        """
        at, total = 0, 0.0
        for c in s:
            move = self.moves[at].get(c)
            if move is None:
                total -= 9.0
            else:
                at = move[0]
                total += move[1]
            if total < least:
                return -math.inf
        return total + self.stops[at]


@dataclass(frozen=True)
class Grammar:
    formats: dict[str, Automaton]
    ordinary: tuple[Automaton, ...]
    ratio: float

    def is_secret(self, run: str) -> bool:
        usual = max((a.log_likelihood(run) for a in self.ordinary), default=-9.0 * len(run))
        for a in self.formats.values():
            # no format can still win once it has fallen below this
            least = max(usual + self.ratio, a.least * (len(run) + 1))
            if a.log_likelihood(run, least) >= least:
                return True
        return False


def labelled_strings(docs: DataFrame, per_kind: int, per_ordinary: int) -> DataFrame:
    """(kind, value): for each kind, the distinct strings that come first by a hash.

    Every task keeps as many at most, so that what is shuffled is bounded by the tasks.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest: dict[str, list[tuple[int, str]]] = {k: [] for k in (*KINDS, *ORDINARY)}
        held: set[tuple[str, str]] = set()

        def offer(kind: str, value: str) -> None:
            heap, rank = lowest[kind], -xxhash.xxh64_intdigest(value)
            most = per_ordinary if kind in ORDINARY else per_kind
            if len(heap) < most or rank > heap[0][0]:
                if (kind, value) in held:
                    return
                held.add((kind, value))
                heapq.heappush(heap, (rank, value))
                if len(heap) > most:
                    held.discard((kind, heapq.heappop(heap)[1]))

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    spans = base_spans(text)
                    for span in spans:
                        offer(KINDS[span[1]], _value(text, span))
                    for start, end in runs(text, spans):
                        run = text[start:end]
                        offer(ORDINARY[_DIGIT.search(run) is not None], run)
        rows = [(kind, value) for kind, heap in lowest.items() for _, value in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"]
        )

    texts = docs.select(F.col("text").cast("string"))
    found = staged(texts.mapInArrow(work, "kind string, value string"), "runs").distinct()
    usual = F.col("kind").isin(*ORDINARY)
    known = first_by_hash(found.filter(~usual), "value", "kind", per_kind)
    return known.unionAll(first_by_hash(found.filter(usual), "value", "kind", per_ordinary))


def infer(docs: DataFrame, settings: Settings | None = None) -> Grammar | None:
    """``None`` if there are no credentials to learn from."""
    s = settings or Settings()
    strings: dict[str, list[str]] = {}
    # a bounded number of strings, of which automata see 256 characters
    found = staged(labelled_strings(docs, s.per_kind, s.per_ordinary), "credentials")
    for kind, value in sorted(tuple(r) for r in found.select("kind", F.left("value", F.lit(256))).collect()):
        strings.setdefault(kind, []).append(value)
    automata = {
        kind: Automaton(values, s.alpha, 3 if kind in ORDINARY else 1) for kind, values in strings.items()
    }
    ordinary = tuple(automata.pop(kind) for kind in ORDINARY if kind in automata)
    return Grammar(automata, ordinary, s.ratio) if automata else None


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, LEARNED)
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned for every row of ``docs``.

    The three counts and the hash are those of the fixed patterns; ``spans`` also has the runs
    that the automata took for secrets (kind ``learned``, after the others of the same start). A
    null text is empty. Equal texts give equal results.
    """
    grammar = infer(docs.select("text"), settings)

    @F.arrow_udf(RESULT)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                text = text or ""
                base = base_spans(text)
                learned = []
                if grammar is not None:
                    learned = [
                        (start, 3, end) for start, end in runs(text, base) if grammar.is_secret(text[start:end])
                    ]
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(sorted(base + learned)), len(learned)))
            names = [c.split()[0] for c in RESULT.split(", ")]
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names)

    return docs.select("doc_id", found(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
