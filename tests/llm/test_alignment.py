"""Aligned ids against whole texts encoded and compared byte by byte."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from dwellframe.llm import alignment
from dwellframe.llm.queries import op12_identity_map

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "bc", " ", "  ", "\n", "\t", "'s", "17", "é", "\xa0", "　", ".", "<|endoftext|>", "<s>", "漢", "\x85", "\x1c", "😀", "\x00", "▁",
         "tokenizer", "Straße", "<0x41>", " "]


def brute_groups(texts):
    """Per text: (tokens of A, of B, groups as lists of ids), or zeros."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    out = []
    for t in texts:
        own = []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == (" " + t).encode() == b"".join(bytes_b):
                own = [list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))]
        if not own:
            out.append((0, 0, []))
            continue
        groups, at, held = [], [0, 0], [[], []]
        sides = [iter(own[0]), iter(own[1])]
        for _ in range(len(own[0]) + len(own[1])):
            k = 0 if at[0] <= at[1] and not (held[0] and at[0] == at[1]) else 1
            i, v = next(sides[k])
            at[k] += len(v)
            held[k].append(i)
            if at[0] == at[1] and all(held):
                groups.append(tuple(held))
                held = [[], []]
        out.append((len(own[0]), len(own[1]), groups))
    return out


def brute_align(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row, and the pair counts."""
    found = brute_groups([t for _, t in rows])
    pairs = Counter((a[-1], b[-1]) for _, _, groups in found for a, b in groups)
    high = {}
    for (_, b), n in pairs.items():
        high[b] = max(n, high.get(b, 0))
    out = []
    for (d, _), (n_a, n_b, groups) in zip(rows, found):
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((d, n_a, n_b, len(groups), len(links), sum(pairs[x] == high[x[1]] for x in links), sum(pairs[x] for x in links), text))
    return out, {(a, b, n, n == high[b]) for (a, b), n in pairs.items()}


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PARTS), max_size=20).map("".join), st.text(max_size=20)), max_size=6))
def test_segments_equal_whole_texts(texts):
    got = alignment.aligner(A, B).block(texts, digest=False)
    want = brute_groups(texts)
    assert got["n_a"].tolist() == [x for x, _, _ in want] and got["n_b"].tolist() == [x for _, x, _ in want]
    assert got["groups"] == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g) for _, _, g in want]


def test_no_piece_crosses_a_blank():
    b = SentencePieceProcessor(model_file=B)
    pieces = (b.id_to_piece(i).lstrip("▁") for i in range(b.get_piece_size()))
    assert not any("▁" in p for p in pieces)


@pytest.mark.parametrize("slice_bytes", [8 << 20, 3000])
def test_counts_over_the_corpus(spark, documents, hard_documents, clashing, no_documents, monkeypatch, slice_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", slice_bytes)
    monkeypatch.setattr(alignment, "KEPT", 50)
    for docs in (documents.limit(60).select("doc_id", "text").union(hard_documents.select("doc_id", "text")), clashing):
        docs = docs.repartition(3)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        got, pairs = alignment.align(docs, A, B)
        want, want_pairs = brute_align([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert ordered(got.collect()) == ordered(want)
        assert {tuple(r) for r in pairs.collect()} == want_pairs
    got, pairs = alignment.align(no_documents, A, B)
    assert got.count() == pairs.count() == 0


def test_query(spark, documents):
    want, _ = brute_align([(r["doc_id"], r["text"]) for r in documents.collect()])
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want]
    got = op12_identity_map(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(got.collect()) == ordered(want)
