"""Exact token counts of a piece vocabulary by a compiled finite-state transducer.

Merging pieces by rank gives a sequence in which every two neighbours are what merging their
joined text alone gives, and no other sequence has that property. So the last piece of a prefix
follows from the last pieces of the few shorter prefixes from which a piece could still begin. A
state is just that: the longest suffix that may still grow into a piece, with the last piece and
the relative count at each of its places. Transitions carry the number of tokens they emit; they
are compiled when first met. A word begin after a word resets the state, so most of a text is
looked up word by word.

A chunk of text is summed up as a map of states; maps compose associatively, and a text's count
is the scan of its chunks' maps.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR = "▁"
CHUNK = 1 << 16
_MAX_STATES = 250_000
_MAX_WORDS = 300_000
_MAX_PAIRS = 300_000
_LONG_WORD = 80
_SEGMENT = re.compile(f"{BAR}+[^{BAR}]*")


@dataclass(frozen=True)
class Pieces:
    """Mergeable pieces with their scores; the highest score merges first."""

    scores: dict[str, float]


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a model file with byte fallback, identity normalisation and word begins."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
    ]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    if any(BAR in piece.lstrip(BAR) for piece in scores):
        raise ValueError("pieces that go on after a word's end are not supported")
    if not {c for piece in scores for c in piece} <= set(scores):
        raise ValueError("a piece holds a character that is no piece")
    probe = "ﬁ Ａ  x"
    if model.decode(model.encode(probe)) != probe or model.encode(""):
        raise ValueError("only models that leave the text as it is are supported")
    return Pieces(scores)


class Transducer:
    """Deterministic, compiled on demand, of bounded size: it starts anew when it is full."""

    def __init__(self, pieces: Pieces) -> None:
        self.scores = pieces.scores
        self.growing = {p[:k] for p in pieces.scores for k in range(len(p))}
        self.edges: dict[str, tuple[list, list]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Counts(self, BAR)
        self.lines = _Counts(self, "\n")
        self.reset()

    def reset(self) -> None:
        """State 0 is the start: nothing before that could merge."""
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self._number(("", (None,), (0,)))
        self.bar = self._move(0, BAR)

    def _number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return found

    def _edges(self, piece: str) -> tuple[list, list]:
        """How the piece at the left and at the right edge grows while ``piece`` is merged.

        Each entry is a rank and the edge from then on; the best pair merges first, the
        leftmost of equals.
        """
        found = self.edges.get(piece)
        if found is None:
            parts = list(piece)
            left, right = [(-math.inf, parts[0])], [(-math.inf, parts[-1])]
            while len(parts) > 1:
                ranks = [-self.scores.get(a + b, -math.inf) for a, b in pairwise(parts)]
                at = ranks.index(min(ranks))
                if ranks[at] == math.inf:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if at == 0:
                    left.append((ranks[at], parts[0]))
                if at == len(parts) - 1:
                    right.append((ranks[at], parts[-1]))
            if len(parts) > 1:  # never the outcome of merging: it stays next to nothing
                left = right = []
            found = self.edges[piece] = (left, right)
        return found

    def _unmerged(self, left: str, right: str) -> bool:
        """Follow both edges in time; does a pair across the border ever come first?"""
        a, b = self._edges(left)[1], self._edges(right)[0]
        if not a or not b:
            return False
        i = j = 0
        while True:
            across = -self.scores.get(a[i][1] + b[j][1], -math.inf)
            next_a = a[i + 1][0] if i + 1 < len(a) else math.inf
            next_b = b[j + 1][0] if j + 1 < len(b) else math.inf
            if across < next_a and across <= next_b and across < math.inf:
                return False
            if next_a == next_b == math.inf:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def stays(self, left: str, right: str) -> bool:
        """Do two pieces stay as they are next to each other?"""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= _MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._unmerged(left, right)
        return found

    def _move(self, number: int, c: str) -> tuple[int, int]:
        live, lasts, counts = self.states[number]
        if c not in self.scores:  # bytes of its own, next to which nothing merges
            move = (0, len(c.encode("utf-8", "surrogatepass")))
        elif c == BAR and number and not (live and live[-1] == BAR):
            move = self.bar
        else:
            text = live + c
            for start in range(len(text)):
                piece = text[start:]
                if piece in self.scores and (lasts[start] is None or self.stays(lasts[start], piece)):
                    break
            else:
                raise AssertionError("no piece ends here")
            emitted = counts[start] + 1
            # only places from which a piece may still grow count; the others are left blank
            lasts, counts = (*lasts, piece), (*(n - emitted for n in counts), 0)
            grows = [text[k:] in self.growing for k in range(len(text) + 1)]
            cut = grows.index(True)
            state = (
                text[cut:],
                tuple([last if g else None for last, g in zip(lasts, grows, strict=True)][cut:]),
                tuple([n if g else 0 for n, g in zip(counts, grows, strict=True)][cut:]),
            )
            move = (self._number(state), emitted)
        self.moves[number][c] = move
        return move

    def run(self, number: int, text: str) -> tuple[int, int]:
        """The state after ``text`` and the tokens emitted on the way."""
        moves, total = self.moves, 0
        for c in text:
            move = moves[number].get(c)
            if move is None:
                move = self._move(number, c)
            number = move[0]
            total += move[1]
        return number, total

    def chunk(self, text: str) -> ChunkMap:
        """``text``: a part of a text, with bars for spaces."""
        first = re.search(f"(?<=[^{BAR}]){BAR}", text)
        if first is None:
            return ChunkMap(text)
        # after a word's end, whole words count on their own; the last one stays open
        rest = text[first.start() :]
        if BAR + BAR in rest:
            words = [w[1:] for w in _SEGMENT.findall(rest)]
        else:
            words = rest.split(BAR)[1:]
        if len(self.states) > _MAX_STATES:
            self.reset()
        last = words.pop()
        total = sum(map(self.words.__getitem__, words))
        return ChunkMap(text[: first.start()], total, BAR + last)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``. Associative."""
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.whole, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.whole, a.tail + b.head)
        return ChunkMap(a.head, a.whole + self.count_open(a.tail + b.head) + b.whole, b.tail)

    def count_open(self, text: str) -> int:
        return self.run(0, text)[1]

    def count(self, text: str, size: int = CHUNK) -> int:
        """Tokens of a whole text, without begin and end."""
        if not text:
            return 0
        text = BAR + text.replace(" ", BAR)
        maps = (self.chunk(text[i : i + size]) for i in range(0, len(text), size))
        whole = reduce(self.compose, maps)
        total = self.count_open(whole.head)
        return total if whole.tail is None else total + whole.whole + self.count_open(whole.tail)


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does to any state before it.

    ``head`` runs from that state; where a word ends in the chunk, the state is reset: ``whole``
    counts the words that begin and end after that, ``tail`` is the word left open. A chunk
    without such a place is all head.
    """

    head: str
    whole: int = 0
    tail: str | None = None


class _Counts(dict):
    """Token counts by the text after ``before``, which resets the state.

    A line break that no piece holds does so too: the lines of a word are looked up one by one.
    """

    def __init__(self, machine: Transducer, before: str) -> None:
        super().__init__()
        self.machine = machine
        self.before = before

    def __missing__(self, text: str) -> int:
        if "\n" in text and "\n" not in self.machine.scores:
            first, *lines = text.split("\n")
            return self[first] + sum(map(self.machine.lines.__getitem__, lines))
        count = self.machine.count_open(self.before + text)
        if len(text) <= _LONG_WORD:
            if len(self) >= _MAX_WORDS:
                self.clear()
            self[text] = count
        return count


_COMPILED: dict[int, Transducer] = {}


def _compiled(pieces: Pieces) -> Transducer:
    """One transducer for each vocabulary and Python process."""
    key = hash(frozenset(pieces.scores.items()))
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(pieces)
    return _COMPILED[key]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    Counts are those of the model's own library, without begin and end tokens; strings that look
    like special tokens are ordinary text. A null text has 0 bytes and 0 tokens.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _compiled(pieces.value)
        for texts in batches:
            yield pa.array([machine.count(t) for t in texts.to_pylist()], pa.int64())

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), counted(text).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
