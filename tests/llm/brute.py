"""Plain single-machine versions that the operators are compared with."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer(plain_text=False):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain_text
    return t


def token_ids(texts, plain_text=False):
    t = tokenizer(plain_text)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def shingles(text, width=5):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def near_classes(rows, threshold=0.8):
    """{row: smallest id of its group} for rows {row: (id, text)}, by comparing all pairs that share a shingle."""
    sets = {k: shingles(t) for k, (_, t) in rows.items()}
    holders, both = defaultdict(list), defaultdict(int)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for ks in holders.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                both[b, a] += 1
    parent = {k: k for k in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            links.add((a, b))
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in rows:
        groups[find(k)].append(k)
    out = {}
    for ks in groups.values():
        ids = [rows[k][0] for k in ks if rows[k][0] is not None]
        out |= {k: min(ids) if ids else None for k in ks}
    return out, links, sets
