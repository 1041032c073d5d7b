"""Token encoder, token files, range coder and packing: exact round trips."""

import io
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dwellframe.llm import common, idfiles, packing, rangecoder, separators, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = ["a", "bc", " ", "  ", "\n", "\t", "'s", "17", "é", " ", "　", ".", ",", "<|endoftext|>", "漢", "\x85", "\x1c", "😀", "\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=20).map("".join), st.text(max_size=20)), max_size=8))
def test_encoder_equals_the_tokenizer(texts):
    for plain in (False, True):
        ids, ends = tokens.encoder(PATH, plain).encode(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]
        assert got == brute.token_ids(texts, plain)


def test_special_tokens_are_ids_unless_asked_to_be_text():
    text = pa.array(["end <|endoftext|>", "x<|endoftext|> y", "<|endoftext|", None])
    ids, ends = tokens.encoder(PATH).encode(text)
    assert [50256 in ids[a:b] for a, b in zip([0, *ends], ends)] == [True, True, False, False]
    assert 50256 not in tokens.encoder(PATH, plain_text=True).encode(text)[0]


def test_encoder_forgets_old_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 20)
    encoder = tokens.Encoder(PATH)
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 15))) for _ in range(4)]
        ids, ends = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == brute.token_ids(texts)
    assert len(encoder.new) + len(encoder.old) < 200


def test_new_pieces_are_encoded_many_at_a_time():
    encoder, given_texts = tokens.Encoder(PATH), []
    encode = encoder._encode
    encoder._encode = lambda texts: given_texts.extend(texts) or encode(texts)
    words = [f"{c}{i}{end}" for i in range(700) for c in ("w", "é", "漢", ".") for end in ("", "\n", "'s")]
    texts = [" ".join(words), "\n x  y", "", None]
    ids, ends = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == brute.token_ids(texts)
    assert len(given_texts) < len(words) // 20


# Range coder

@pytest.mark.parametrize("block", [16, 2048, 4096])
def test_coder_round_trips(block):
    rng = np.random.default_rng(block)
    for k in range(12):
        n = int(rng.integers(1, 5000))
        ids = (rng.zipf(1.3, n) % 65536 if k % 2 else rng.integers(0, 1 + int(rng.integers(65536)), n)).astype(np.uint16)
        literals, words = rangecoder.encode_blocks(ids, block)
        assert (rangecoder.decode_blocks(literals, words, n, block) == ids).all()
        for b in {0, len(words) - 1} if k < 2 else ():  # any block by itself
            own = ids[b * block:(b + 1) * block]
            assert (rangecoder.decode_blocks(literals[b:b + 1], words[b:b + 1], len(own), block) == own).all()


def test_every_id_and_one_id():
    for ids in (np.arange(65536), np.zeros(5000), np.array([65535])):
        ids = ids.astype(np.uint16)
        literals, words = rangecoder.encode_blocks(ids)
        assert (rangecoder.decode_blocks(literals, words, len(ids)) == ids).all()


def test_repetition_is_cheap():
    phrase = np.random.default_rng(1).integers(0, 50_000, 20)
    literals, words = rangecoder.encode_blocks(np.tile(phrase, 500).astype(np.uint16))
    assert sum(map(len, literals + words)) * 16 / 10_000 < 1.5  # bits an id; the order-0 entropy is over 4


def test_every_block_starts_anew():
    rng = np.random.default_rng(8)
    one = rng.integers(0, 300, 4096).astype(np.uint16)
    literals, words = rangecoder.encode_blocks(np.tile(one, 3))
    assert all((x == literals[0]).all() for x in literals) and all((w == words[0]).all() for w in words)


def test_order_0_adapts_to_the_block():
    # Independent draws, so orders 1 and 2 have nothing to say: the code comes near the entropy of the draws.
    p = 0.5 ** np.arange(1, 13)
    ids = np.random.default_rng(9).choice(12, 8192, p=p / p.sum()).astype(np.uint16) * 5000
    literals, words = rangecoder.encode_blocks(ids)
    entropy = -(p / p.sum() * np.log2(p / p.sum())).sum()
    assert entropy < sum(map(len, literals + words)) * 16 / 8192 < 1.15 * entropy


def test_counts_find_what_they_count():
    rng = np.random.default_rng(10)
    counts, plain = rangecoder.Counts(2), [{}, {}]
    for _ in range(600):
        if counts.t:
            for b in range(2):
                at = np.array([b])
                for place in range(0, 2 * counts.t, 1 + counts.t // 9):
                    number = counts.number_at(np.array([place]), at)
                    start, amount = counts.find(number, at)
                    assert start[0] <= place < start[0] + amount[0]
                    assert amount[0] == plain[b].get(int(number[0]), len(plain[b]))
        step = np.array([min(int(rng.zipf(1.2)) - 1, len(plain[b])) for b in range(2)], dtype=np.int32)
        counts.learn(step)
        for b in range(2):
            plain[b][int(step[b])] = plain[b].get(int(step[b]), -1) + 2


def test_file_format_and_damage():
    ids = np.arange(5000, dtype=np.uint16) % 300
    data = rangecoder.encode_group(ids, [5, None, 7], [3000, 0, 2000]) + rangecoder.encode_group(ids[:0], [], [])
    (got, doc_ids, lengths), (none, _, _) = list(rangecoder.read_groups(io.BytesIO(data)))
    assert (got == ids).all() and doc_ids == [5, None, 7] and lengths.tolist() == [3000, 0, 2000] and not len(none)
    one = len(rangecoder.encode_group(ids[:0], [], []))
    damaged = bytearray(data)
    damaged[len(data) - one - 5] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(rangecoder.read_groups(io.BytesIO(bytes(damaged))))
    with pytest.raises(ValueError):
        list(rangecoder.read_groups(io.BytesIO(b"junk" * 20)))
    with pytest.raises(ValueError):
        rangecoder.encode_group(np.array([70_000], dtype=np.uint32), [1], [1])


def test_id_files(spark, documents, clashing, no_documents):
    for docs in (documents, clashing):
        got = idfiles.read_ids(spark, idfiles.write_ids(docs, PATH, end_id=2)).collect()
        rows = sorted(((d is not None, d or 0, t) for d, t in docs.select("doc_id", "text").collect()), key=lambda x: x[:2])
        ids = [x + [2] for x in brute.token_ids([t for _, _, t in rows])]
        got.sort(key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [d if known else None for known, d, _ in rows]
        assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
        key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(
            ((d if known else None, len(x), brute.crc(x)) for (known, d, _), x in zip(rows, ids)), key=key)
    assert idfiles.read_ids(spark, idfiles.write_ids(no_documents, PATH)).count() == 0


# Separator scan

def test_counts_over_any_block_size(spark, tmp_path):
    rng = np.random.default_rng(2)
    want, paths = {}, []
    for f in range(4):
        docs = [rng.integers(0, 50_000, int(n)) for n in rng.choice([0, 1, 5, 300], 40)] if f else []
        flat = np.concatenate([np.append(d, 50256) for d in docs] + [[]]).astype("<u2")
        if f == 2:
            flat = np.append(flat, np.array([1, 2, 3], dtype="<u2"))  # an open document
        path = tmp_path / f"f{f}.bin"
        path.write_bytes(flat.tobytes())
        paths.append((str(path),))
        want[str(path)] = [len(d) for d in docs] + ([3] if f == 2 else [])
    found = spark.createDataFrame(paths, "file string")
    for block in (2, 14, 1 << 20):
        got = separators.count_tokens(found, 50256, block_bytes=block).collect()
        for path, sizes in want.items():
            rows = sorted((r for r in got if r["file"] == path), key=lambda r: r["ordinal"])
            assert [r["ordinal"] for r in rows] == list(range(len(sizes)))
            assert [r["n_tokens"] for r in rows] == sizes
            assert [r["start"] for r in rows] == [sum(sizes[:i]) + i for i in range(len(sizes))]
            assert [r["closed"] for r in rows] == [True] * len(rows) if "f2" not in path else not rows[-1]["closed"]


def test_counts_of_documents(spark, documents, clashing, no_documents):
    for docs in (documents, clashing):
        order = separators.write_flat(docs, PATH, end_id=50256)
        got = separators.count_tokens(order.select("file"), 50256).join(order, ["file", "ordinal"])
        key = lambda x: (x[0] is not None, x[0] or 0, x[1])
        rows = docs.select("doc_id", "text").collect()
        assert sorted(((r["doc_id"], r["n_tokens"]) for r in got.collect()), key=key) == sorted(
            ((d, len(x)) for (d, _), x in zip(rows, brute.token_ids([t for _, t in rows], plain_text=True))), key=key)
    order = separators.write_flat(no_documents, PATH, end_id=50256)
    assert separators.count_tokens(order.select("file"), 50256).count() == 0


# Packing

def check_packing(got, docs, capacity, end_id=0):
    rows = docs.select("doc_id", "text").collect()
    ids = {}
    for (d, _), x in zip(rows, brute.token_ids([t for _, t in rows])):
        ids.setdefault(d, []).append(x + [end_id])
    bins, pieces = {}, {}
    for r in got:
        assert 0 < r["length"] <= capacity
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    for d, lists in ids.items():
        want = []
        for x in lists:
            first = len(x) if len(x) <= capacity else len(x) % capacity or capacity
            cuts = [0, *range(first, len(x) + 1, capacity)]
            want += [(k, a, b - a, brute.crc(x[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(pieces[d]) == sorted(want)
    return len(bins), sum(r["length"] for r in got)


def test_packing_is_exact_and_tight(documents, clashing, no_documents):
    n, total = check_packing(packing.pack(documents, PATH).collect(), documents, 2048)
    assert n <= -(-total // 2048) + 1
    check_packing(packing.pack(clashing, PATH, capacity=64, group_size=5).collect(), clashing, 64)
    assert packing.pack(no_documents, PATH).count() == 0


def test_badly_fitting_pieces_over_many_groups(spark):
    """Two groups of pieces of which two seldom fill a sequence, against best fit over one pool."""
    sizes = np.random.default_rng(9).integers(900, 1400, 20_000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "row long, size int")
    got = packing.place(items, common.Scratch(spark), 2048).collect()
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["row"]]))
    assert len(got) == len(sizes) == len({r["row"] for r in got})
    assert all(sum(s for _, s in x) <= 2048 and sum(s for _, s in x) == max(o + s for o, s in x) for x in filled.values())
    pool, room = [], []
    packing.best_fit(pool, room, range(len(sizes)), sizes, 2048)
    assert len(filled) <= len(pool) * 1.002


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 100, int(rng.integers(1, 80))).tolist()
        people = packing.evolve(sizes, [], 100, int(rng.integers(1000)), 4, 0)
        for bins in (packing.crossover(people[0], people[-1], sizes, 100, rng), packing.mutate(people[0], sizes, 100, rng)):
            assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in b) <= 100 for b in bins)


def test_evolution_beats_best_fit():
    # Triples of 100 that best fit decreasing breaks up.
    rng = np.random.default_rng(0)
    sizes = []
    for _ in range(25):
        a = int(rng.integers(26, 40))
        b = int(rng.integers(26, 40))
        sizes += [a, b, 100 - a - b]
    start = packing.evolve(sizes, [], 100, 1, 1, 0)[0]
    best = packing.evolve(sizes, [], 100, 1, 6, 400)[0]
    assert 25 <= len(best) < len(start)
