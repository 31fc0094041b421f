"""The conversation trie by plain loops, for tests."""

import hashlib
import re
import zlib


def brute_trie(rows):
    """rows: (conv_id, turn, role, text); returns the rows of op12 as tuples in OUT_COLUMNS order."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is None:
            continue
        convs.setdefault(conv, []).append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    ordered = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = ordered.get(base, [])[:h] + ordered[c][h:]
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    kids = {}
    for prefix in nodes:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)
    for prefix, members in nodes.items():
        d = len(prefix)
        sub = [p for p in nodes if p[:d] == prefix]
        leaves = sum(1 for p in sub if p not in kids)
        saved = sum((len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0) for p in sub)
        ends = sorted(c for c in members if len(built[c]) == d)
        out.append((
            min(members), d, min(nodes[prefix[:-1]]) if prefix else None, len(members), len(kids.get(prefix, [])),
            leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)
