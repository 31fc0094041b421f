"""Best-fit packing: every new sequence takes the fullest combination of the waiting pieces.

Documents are tokenized (``tokenizers``, no special tokens added, id 0 appended); a document of
more than ``capacity`` ids is cut into ``capacity``-id pieces, the first piece taking the
remainder. A full piece fills a sequence alone. The other pieces are dealt to shards by a hash
of their row, about ``shard_pieces`` a shard, and each shard is packed in one task by minimum
bin slack: a sequence opens with the longest piece still waiting, a bitset subset-sum over the
lengths still waiting (a length counted as often as it waits, no more than fit) finds the
largest sum that fits the room left, the pieces giving it are taken out with it, and so on
until none waits.

Rules: a null text is empty (its piece holds the appended id alone); a row is a document, so a
repeated doc_id is packed once per row; ``ids_crc32`` is the unsigned CRC-32 of the piece's ids
as little-endian unsigned 32-bit words. Sequence ids are unique, not dense: full pieces get
numbers from 0, packed sequences negative ones. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import json
import math
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

CAPACITY = 2048
SHARD_PIECES = 20_000
END_ID = 0
_END = END_ID.to_bytes(4, "little")
ENCODE_CHARS = 1 << 20  # characters given to the tokenizer at once (its encodings are large)
RUN_CHARS = 1 << 23  # characters of the texts whose distinct words are looked up together
CACHED_WORDS = 750_000  # a run of texts may add its own words before the cache starts anew
LONG_WORD = 64  # longer words are not cached

PIECES = "row_key bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"
OUT_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

# what may or may not be white space to the library; a word never ends after one of these
_RARE = r"\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff"
_RARE_SPACE = re.compile(f"[{_RARE}]")
_RARE_EDGE = re.compile(f"(?<=[^ \\t\\r\\n{_RARE}])(?=[ \\t\\r\\n])")
# white space before a space, or that may be none to the library: such texts are not cut at spaces
_NOT_AT_SPACES = re.compile(f"[ \\t\\r\\n] |[{_RARE}]").search
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# a line break before a word, a plain word that no letter goes on, else up to the next white space
_WORD = re.compile(rf"\n(?=[{_LETTERS}])| ?[{_LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z)|[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
_PLAIN = re.compile(f" ?[{_LETTERS}]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """How byte-level models write the bytes of a text."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_BYTE_LETTERS = _byte_letters()

_ENCODERS: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of whole texts by the library's tokenizer, every distinct word encoded once.

    A byte-level pretokenizer always ends a token where white space follows something else and
    where a letter ends a word, so a text's ids are those of its words (with the white space
    before them) one after the other.
    Other tokenizers, and texts that hold an added token, are encoded whole. The cache of short
    words starts anew when it is full.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # Spark's tasks are what runs at the same time
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.by_word = _by_word(json.load(file))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _merged(self, word: str) -> bytes:
        """Ids of a plain word: one token of the pretokenizer, which goes to the model as it is."""
        if word.isascii():
            found = self.model.tokenize(word.replace(" ", _BYTE_LETTERS[ord(" ")]))
        else:
            found = self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_LETTERS))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _split(self, text: str) -> list[str]:
        if not self.by_word or any(t in text for t in self.added):
            return [text]
        return _RARE_EDGE.split(text) if _RARE_SPACE.search(text) else _WORD.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit words."""
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        spaced = [self.by_word and not _NOT_AT_SPACES(t) and not any(a in t for a in self.added) for t in texts]
        of_spaced = iter(self._at_spaces([t for t, s in zip(texts, spaced, strict=True) if s]))
        of_others = iter(_each(*self._ids([t for t, s in zip(texts, spaced, strict=True) if not s], self._split)))
        return [next(of_spaced if s else of_others) for s in spaced]

    def _at_spaces(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut before every space: each distinct part is looked at once."""
        if not texts:
            return []
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = parts.offsets.to_numpy()
        coded = parts.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy().astype(np.int64)
        firsts = [t.partition(" ")[0] for t in texts]  # no space goes before these
        at[bounds[:-1]] = len(names) + np.arange(len(texts))
        ids, starts = self._ids([" " + name for name in names] + firsts, _WORD.findall)
        lengths = np.diff(starts)[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(starts[at] - ends[:-1], lengths) + np.arange(ends[-1])
        return _each(ids[take], ends[bounds])

    def _ids(self, texts: list[str], split: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more for the end)."""
        words: list[str] = []
        bounds = [0]
        for text in texts:
            words += split(text)
            bounds.append(len(words))
        found = list(map(self.words.get, words))
        new = {w for w, ids in zip(words, found, strict=True) if ids is None}
        plain = set(filter(_PLAIN, new)) if self.by_word else set()
        known = {w: self._merged(w) for w in plain}
        rest = list(new - plain)
        for lo, hi in _bounded(rest, ENCODE_CHARS):
            known.update(zip(rest[lo:hi], self._encoded(rest[lo:hi]), strict=True))
        self.words.update((w, ids) for w, ids in known.items() if len(w) <= LONG_WORD)
        if known:
            found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        ends = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=ends[1:])
        return np.frombuffer(b"".join(found), "<u4"), ends[bounds]


def _each(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [ids[lo:hi].tobytes() for lo, hi in itertools.pairwise(bounds.tolist())]


def _by_word(settings: dict) -> bool:
    """Does the tokenizer of these settings encode words on their own?"""
    pre = settings.get("pre_tokenizer") or {}
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and settings["model"].get("type") == "BPE"
        and not settings["model"].get("dropout")
        and not any(settings.get(k) for k in ("normalizer", "truncation", "padding"))
    )


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def cut(n_ids: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of every piece of a document of ``n_ids`` ids."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def _bounded(texts: list[str], most_chars: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts holding about ``most_chars`` characters (a longer text alone)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most_chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def _pieces(tokenizer_path: str, capacity: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            for lo, hi in _bounded(texts, RUN_CHARS):
                out: dict[str, list] = {k: [] for k in _PIECES_SCHEMA.names}
                for key, doc, words in zip(keys[lo:hi], ids[lo:hi], encoder.encode(texts[lo:hi]), strict=True):
                    words += _END
                    for n, (start, length) in enumerate(cut(len(words) // 4, capacity)):
                        out["row_key"].append(key)
                        out["doc_id"].append(doc)
                        out["piece"].append(n)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(words[4 * start : 4 * (start + length)]))
                yield pa.RecordBatch.from_pydict(out, schema=_PIECES_SCHEMA)

    return split


_PIECES_SCHEMA = pa.schema(
    [("row_key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
     ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of the fullest combination that fits, from ``counts[length]`` waiting pieces.

    A bitset of reachable sums, held in one integer; every step keeps the sums it was the first
    to reach, so the combination is read back from the best sum through the steps that gave it.
    """
    reach, all_sums = 1, (1 << (capacity + 1)) - 1
    steps: list[tuple[int, int]] = []
    for length in np.flatnonzero(counts[: capacity + 1])[::-1].tolist():
        if length == 0:
            continue
        for _ in range(min(int(counts[length]), capacity // length)):
            new = (reach << length) & all_sums & ~reach
            if not new:
                break
            steps.append((length, new))
            reach |= new
            if reach >> capacity:
                break
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    taken = []
    for length, new in reversed(steps):
        if new >> total & 1:
            taken.append(length)
            total -= length
    return taken


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence number of every piece, packed by minimum bin slack (pieces of length 0 join the first)."""
    lengths = np.asarray(lengths, np.int64)
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    counts = np.zeros(capacity + 1, np.int64)
    for length, items in waiting.items():
        counts[length] = len(items)
    bins = np.full(len(lengths), -1, np.int64)
    current = 0
    while counts[1:].any():
        largest = int(np.flatnonzero(counts)[-1])
        bins[waiting[largest].pop()] = current
        counts[largest] -= 1
        for length in fullest(counts, capacity - largest):
            bins[waiting[length].pop()] = current
            counts[length] -= 1
        current += 1
    bins[bins < 0] = 0  # empty pieces take no room
    return bins


def _pack_shard(frame: pd.DataFrame) -> pd.DataFrame:
    if not len(frame):
        return frame.drop(columns=["shard"]).assign(sequence_id=[], offset=[])
    order = frame.sort_values(["row_key", "piece"], kind="stable").reset_index(drop=True)
    bins = pack_lengths(order["length"].to_numpy(), CAPACITY)
    shard = int(order["shard"].iloc[0])
    order["sequence_id"] = -((shard << 32) | bins) - 1
    order = order.assign(bin=bins).sort_values(["bin", "length", "row_key", "piece"], ascending=[True, False, True, True])
    order["offset"] = order.groupby("bin")["length"].cumsum() - order["length"]
    return order.drop(columns=["bin", "shard"])


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of every document with their sequence and place (see the module's rules)."""
    rows = documents.select(
        F.monotonically_increasing_id().alias("row_key"), F.col("doc_id").cast("bigint"), F.col("text")
    )
    pieces = staged(rows.mapInArrow(_pieces(tokenizer_path, capacity), PIECES), "best-fit-pieces")

    full = pieces.filter(F.col("length") == capacity).select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity)
    shards = max(1, math.ceil(rest.count() / shard_pieces))
    packed = (
        rest.withColumn("shard", F.pmod(F.xxhash64("row_key", "piece"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_pack_shard, PACKED)
    )
    return full.unionByName(packed).select(*OUT_COLUMNS)
