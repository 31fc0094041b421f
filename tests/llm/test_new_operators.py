"""Hard negatives, conversation trie and best-fit packing against plain loops on small rows."""

import itertools
import os
import sys
import math
import random

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barscreen.llm import hard_negatives  # noqa: E402

EMB = "vec_id long, embedding array<float>, label int, hard_negatives string"


def brute_negatives(rows):
    usable = []
    for vid, emb, label, _ in rows:
        if label is None or emb is None or any(x is None or not math.isfinite(x) for x in emb):
            continue
        lab = (label + 1) % 10 if vid % 7 == 0 else label
        usable.append((vid, lab, [math.floor(256 * float(x)) for x in emb]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for aid, alab, aq in usable:
        if aid % 100:
            continue
        scored = [(score(aq, q), vid, lab) for vid, lab, q in usable]
        order = sorted(scored, key=lambda t: (-t[0], t[1]))
        positives = [t for t in order if t[2] == alab and t[1] != aid][:5]
        for ps, pid, _ in positives:
            band = [t for t in order if t[2] != alab and 80 * ps <= 100 * t[0] <= 100 * ps][:5]
            out += [(aid, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(band, 1)]
    return sorted(out)


def negatives_of(df):
    return sorted(tuple(r) for r in df.select(*hard_negatives.OUT_COLUMNS).collect())


def test_hard_negatives_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for vid in range(0, 1400):
        emb = [round(rng.gauss(0, 0.3), 2) for _ in range(6)]
        rows.append((vid, emb, rng.randrange(3), "x"))
    rows += [(100, [0.1] * 6, 1, "copy"), (1500, rows[5][1], rows[5][2], "tie")]  # repeated id, tied vector
    rows += [(1600, None, 1, "n"), (1700, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "n"), (1800, [math.inf] + [0.0] * 5, 1, "n")]
    rows += [(1900, [0.5] * 6, None, "n"), (2000, [0.01, 0.02], 2, "short")]
    df = spark.createDataFrame(rows, EMB)
    got = negatives_of(hard_negatives.mine(df, block=16))
    assert got == brute_negatives(rows)
    assert len(got) > 100


def test_hard_negatives_of_an_empty_table_and_of_one_label(spark):
    assert hard_negatives.mine(spark.createDataFrame([], EMB)).count() == 0
    rows = [(i, [float(i % 3), 1.0], 4, None) for i in range(0, 400, 10)]
    assert negatives_of(hard_negatives.mine(spark.createDataFrame(rows, EMB), block=4)) == brute_negatives(rows)


def test_hard_negatives_read_fewer_blocks_than_all(spark):
    rows = [(i, [1.0 if i % 2 else -1.0, (i % 50) / 50.0, 0.0], i % 2, None) for i in range(3000)]
    df = spark.createDataFrame(rows, EMB)
    assert negatives_of(hard_negatives.mine(df, block=32)) == brute_negatives(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_hilbert_index_visits_neighbours(bits):
    import numpy as np

    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij")).reshape(3, -1).T
    h = hard_negatives.hilbert_index(grid, bits)
    path = grid[np.argsort(h)]
    assert len(set(h.tolist())) == len(grid)
    assert np.abs(np.diff(path, axis=0)).sum(axis=1).max() == 1


DOCS13 = "doc_id long, text string, row_key string, sequence_id int"


def test_best_fit_pieces_and_sequences_equal_a_plain_loop(spark):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from barscreen.llm import best_fit
    from barscreen.llm.queries import tokenizer

    path = tokenizer("byte_bpe_50k.json")
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "<|endoftext|>", "délta", "\n\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 900))) for _ in range(60)]
    texts += [None, "", "x " * 5000, "x " * 5000, "y" * 3000]  # null, empty, long and repeated rows
    rows = [(i % 50, t, "clash", 1) for i, t in enumerate(texts)]
    got = best_fit.pack(spark.createDataFrame(rows, DOCS13), path).collect()

    tok = Tokenizer.from_file(path)
    expected = []
    for doc, text, _, _ in rows:
        ids = np.asarray(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, (start, length) in enumerate(best_fit.cut(len(ids))):
            expected.append((doc, n, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    assert any(p[1] > 0 for p in expected) and all(p[3] <= 2048 for p in expected)

    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in itertools.pairwise(parts))
        assert sum(length for _, length in parts) <= 2048
    first_fit = []  # first fit decreasing, for comparison
    for length in sorted((r.length for r in got), reverse=True):
        for i, used in enumerate(first_fit):
            if used + length <= 2048:
                first_fit[i] += length
                break
        else:
            first_fit.append(length)
    big = sum(1 for r in got if r.length > 1024)
    assert max(big, -(-sum(first_fit) // 2048)) <= len(sequences) <= len(first_fit)


def test_best_fit_finds_the_fullest_bins():
    from barscreen.llm import best_fit

    # first fit decreasing needs three bins of 10 here, the fullest combinations two
    lengths = [6, 5, 5, 4]
    assert len(set(best_fit.pack_lengths(lengths, 10))) == 2
    rng = random.Random(1)
    halves = [rng.randrange(1, 2048) for _ in range(400)]
    lengths = halves + [2048 - h for h in halves]
    rng.shuffle(lengths)
    bins = best_fit.pack_lengths(lengths)
    assert len(set(bins)) == 400
    for b in set(bins):
        assert sum(length for length, x in zip(lengths, bins) if x == b) <= 2048
    assert len(best_fit.pack_lengths([])) == 0


def test_best_fit_of_an_empty_table(spark):
    from barscreen.llm import best_fit
    from barscreen.llm.queries import tokenizer

    assert best_fit.pack(spark.createDataFrame([], DOCS13), tokenizer("byte_bpe_50k.json")).count() == 0


CONV = "conv_id long, turn long, role string, text string, depth int, node string"


def trie_rows(spark, rows):
    from barscreen.llm import prefix_trie

    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], CONV)
    return sorted((tuple(r) for r in prefix_trie.trie(df).select(*prefix_trie.OUT_COLUMNS).collect()), key=repr)


def test_conversation_trie_equals_a_plain_loop(spark):
    from trie_brute import brute_trie

    rng = random.Random(7)
    texts = ["hi there", "hello", "", "how are you?", "fine  thanks\tbye", None]
    rows = []
    for conv in list(range(0, 70)) + [100, 101, 119, -3, -20]:
        for turn in range(rng.randrange(0, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (6, 2, "user", "again"), (None, 1, "user", "x")]
    rows += [(200, 0, "user", "w " * 3000)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_conversation_trie_of_no_rows_and_of_turnless_conversations(spark):
    from trie_brute import brute_trie

    assert trie_rows(spark, []) == []
    rows = [(41, 0, "user", "a"), (41, 1, "user", "b"), (None, 0, "user", "c")]
    got = trie_rows(spark, rows)
    assert got == brute_trie(rows)
    assert got[0][1] == 0 and got[0][3] == 1


def test_best_fit_encodes_each_word_once_and_as_the_library_does():
    import numpy as np

    from barscreen.llm import best_fit
    from barscreen.llm.queries import tokenizer

    rng = random.Random(11)
    parts = ["ab", " ab", "Été", "it's", "'S", "x9", "9,", " ", "  ", "\n", "\n\n", "\r", "\t", "\x0b", "\x1c", "\x85", "\xa0"]
    parts += ["᠎", " ", "　", "中文", "😀", "é", "***", "(a)", "<|endoftext|>", "z" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 12))) for _ in range(20_000)]
    encoder = best_fit._Encoder(tokenizer("byte_bpe_50k.json"))
    assert encoder.by_word
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in whole]

    encoder.words.clear()
    encoder.encode(["some words of some words, some\nwords"] * 50)
    assert set(encoder.words) == {"some", " words", " of", " some", ",", "\n", "words"}
    encoder.by_word = False  # another tokenizer: every text whole
    assert encoder.encode(texts[:500]) == [np.asarray(e.ids, "<u4").tobytes() for e in whole[:500]]
