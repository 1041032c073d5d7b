"""Token ids in files of an adaptive context-mixing range coder.

File format, little-endian. A file is a row of groups; a group holds whole
documents and is decoded without the others:

    magic "TIDC", u8 version, u8 zero, u16 block length,
    u64 ids, u32 documents, u32 bytes of the document table, u32 bytes of the blocks,
    document table: zlib of u8 has-an-id, i64 ids, u64 lengths,
    u32 literals of each block, u32 words of each block, u32 crc32 of each block,
    then for each block its literals and its words, 16 bits each.

Ids are cut into blocks that are coded each by itself: every block starts from
the same empty state, carries its own checksum and can be decoded without the
others. Its literals are the ids that occur in it, in order of first occurrence;
inside the block an id is its number among them. The coder predicts numbers by
three orders that all adapt in the block: orders 2 and 1 name the number last
seen after the same two numbers, or the same one, and order 0 counts what came
so far, with an escape to the next literal. How far the predictions of orders 2
and 1 are trusted adapts to how often predictions of the same confidence came
true; the trust that is left goes to order 0. All blocks of a group advance
together, one id a step, as numpy arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = b"TIDC", 2
HEAD = struct.Struct("<4sBBHQIII")
BLOCK = 4096  # at most this: a number has three digits of four bits
TOTAL = 1 << 16
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 32)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
_SLOTS = 1 << 12
_SUMS, _56 = np.uint64(0x0101010101010101), np.uint64(56)


class Trust:
    """Predictions of orders 2 and 1 and their shares of the coding interval, for all blocks at once."""

    def __init__(self, blocks: int):
        self.base = np.arange(blocks, dtype=np.int32) * _SLOTS
        self.order1 = np.zeros(blocks * _SLOTS, dtype=np.int16)  # number and confidence (0 to 7)
        self.order2 = np.zeros(blocks * _SLOTS, dtype=np.int16)
        self.shares_at = np.arange(blocks, dtype=np.int32) * 64
        self.shares = np.full(blocks * 64, TOTAL // 3, dtype=np.int32)
        self.last = np.zeros(blocks, dtype=np.uint32)
        self.before = np.zeros(blocks, dtype=np.uint32)

    def predict(self):
        """Widths of the intervals of orders 2 and 1 (0: no prediction); their numbers are ``id2`` and ``id1``."""
        mixed = self.last * np.uint32(0x9E3779B1) ^ self.before * np.uint32(0x85EBCA6B)
        self.at1 = self.last.view(np.int32) + self.base
        self.at2 = (mixed >> np.uint32(20)).view(np.int32) + self.base
        self.seen1, self.seen2 = self.order1[self.at1], self.order2[self.at2]
        self.id1, self.id2 = self.seen1 >> 3, self.seen2 >> 3
        sure1, sure2 = self.seen1 & 7, self.seen2 & 7
        same = self.id1 == self.id2
        context = (np.minimum(sure2, 3) << 3) + (np.minimum(sure1, 3) << 1) + same
        self.at = self.shares_at + (context << 1)
        width2 = np.clip(self.shares[self.at], 32, TOTAL - 128) * (sure2 > 0)
        rest = TOTAL - width2
        width1 = np.clip(((rest >> 2) * (self.shares[self.at + 1] >> 2)) >> 12, 16, rest - 16) * ((sure1 > 0) & ~same)
        return width2, width1

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        old = self.shares[self.at]
        self.shares[self.at] = old + ((hit2 * TOTAL - old) >> 4)
        self.at += 1
        old = self.shares[self.at]
        self.shares[self.at] = old + (((hit1 * TOTAL - old) >> 4) * ~hit2)
        fresh = (ids << 3) | 1
        for table, at, seen, known in ((self.order1, self.at1, self.seen1, self.id1), (self.order2, self.at2, self.seen2, self.id2)):
            sure = seen & 7
            right = (known == ids) & (sure > 0)
            # A right prediction grows surer; a wrong one loses half and gives way when nothing is left.
            table[at] = np.where(right, np.minimum(sure + 1, 7) | (seen & ~7), np.where(sure > 1, (seen & ~7) | (sure >> 1), fresh))
        self.before, self.last = self.last, ids.astype(np.uint32)


class Counts:
    """Order 0 of all blocks at once: how often each number came, with sums over a tree of three digits.

    A number counts 1 when it is first seen and 2 each time after; the escape counts
    as many as there are numbers. After t ids the whole is 2t in every block.
    """

    # Row 16 * (amount - 1) + digit: what an amount adds to the sums below each digit.
    ADDED = np.concatenate([n * (np.arange(16)[None, :] > np.arange(16)[:, None]) for n in (1, 2)]).astype(np.uint16)

    def __init__(self, blocks: int):
        self.below = [np.zeros((blocks * n, 16), dtype=np.uint16) for n in (1, 16, 256)]
        self.base = [np.arange(blocks, dtype=np.int32) * n for n in (1, 16, 256)]
        self.count = np.zeros(blocks * 4096, dtype=np.uint16)
        self.leaves = np.arange(blocks, dtype=np.int32) * 4096
        self.seen = np.zeros(blocks, dtype=np.int32)
        self.t = 0

    def find(self, number: np.ndarray, at=slice(None)):
        """Place and amount of the numbers of the blocks ``at``; the next new number is the escape."""
        place = self.below[0].reshape(-1).take((self.base[0][at] << 4) + (number >> 8)).astype(np.int32)
        place += self.below[1].reshape(-1).take((self.base[1][at] << 4) + (number >> 4))
        place += self.below[2].reshape(-1).take(self.leaves[at] + number)
        amount = self.count.take(self.leaves[at] + number).astype(np.int32)
        seen = self.seen[at]
        new = np.flatnonzero(number == seen)
        place[new], amount[new] = 2 * self.t - seen[new], seen[new]
        return place, amount

    def number_at(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of the blocks ``at`` that hold these places."""
        seen = self.seen[at]
        escape = place >= 2 * self.t - seen
        left = np.where(escape, 0, place).astype(np.uint16)
        number = np.zeros(len(at), dtype=np.int32)
        for k in range(3):
            row = self.below[k].take(self.base[k][at] + number, axis=0)
            passed = (row <= left[:, None]).view(np.uint64)  # eight flags a word, whose sum is taken at once
            digit = ((passed[:, 0] + passed[:, 1]) * _SUMS >> _56).astype(np.int32) - 1
            left -= row.reshape(-1).take(np.arange(0, 16 * len(at), 16) + digit)
            number = (number << 4) + digit
        return np.where(escape, seen, number)

    def learn(self, number: np.ndarray) -> None:
        new = number == self.seen
        amount = np.where(new, 0, 16)
        self.below[0] += self.ADDED.take(amount + (number >> 8), axis=0)
        for k in (1, 2):
            node = self.base[k] + (number >> (12 - 4 * k))
            self.below[k][node] = self.below[k].take(node, axis=0) + self.ADDED.take(amount + ((number >> (8 - 4 * k)) & 15), axis=0)
        self.count[self.leaves + number] += (2 - new).astype(np.uint16)
        self.seen += new
        self.t += 1


class Rest:
    """Order 0 without the numbers that orders 2 and 1 named, as those have intervals of their own."""

    def __init__(self, counts: Counts, model: Trust, width2: np.ndarray, width1: np.ndarray):
        self.counts = counts
        (a, x), (b, y) = (counts.find(i.astype(np.int32)) for i in (model.id2, model.id1))
        x, y = x * (width2 > 0), y * (width1 > 0)
        turned = b < a
        self.at1, self.n1 = np.where(turned, b, a), np.where(turned, y, x)
        self.at2, self.n2 = np.where(turned, a, b), np.where(turned, x, y)
        self.total = 2 * counts.t - x - y

    def find(self, number: np.ndarray, at=slice(None)):
        """Place and amount of the numbers of the blocks ``at``."""
        place, amount = self.counts.find(number, at)
        return place - self.n1[at] * (place > self.at1[at]) - self.n2[at] * (place > self.at2[at]), amount

    def number_at(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers of the blocks ``at`` that hold these places."""
        place = np.minimum(place, self.total[at] - 1)
        place = place + self.n1[at] * (place >= self.at1[at])
        return self.counts.number_at(place + self.n2[at] * (place >= self.at2[at]), at)


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(literals, numbers) of a block: its ids by first occurrence, and each id's number among them."""
    first = np.zeros(TOTAL, dtype=np.int32)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    came = first[ids]
    new = came == np.arange(len(ids))
    return ids[new], (np.cumsum(new) - 1)[came]


def settle(low, width, move) -> None:
    """Moves words out of, or into, the intervals until every width spans at least 32 bits.

    ``move(at)`` handles the upper word of the blocks ``at``. An interval that
    straddles a carry while it is narrow is cut at the carry, so no word that
    has left changes again.
    """
    todo = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOT))
    while len(todo):
        lo, w = low[todo], width[todo]
        w = np.where((lo ^ (lo + w)) < _TOP, w, (~lo + np.uint64(1)) & (_BOT - np.uint64(1)))
        move(todo)
        lo, w = lo << _16, w << _16
        low[todo], width[todo] = lo, w
        todo = todo[((lo ^ (lo + w)) < _TOP) | (w < _BOT)]


def encode_blocks(ids: np.ndarray, block: int = BLOCK):
    """(literals, words) of every block, as lists of uint16 arrays.

    An id is coded in one step: within the interval of the prediction that is
    right, or within its order-0 part of the rest. The first id is the first literal.
    """
    if not 0 < block <= BLOCK:
        raise ValueError(f"a block holds 1 to {BLOCK} ids")
    blocks = -(-len(ids) // block)
    padded = np.full(blocks * block, ids[-1], dtype=np.uint16)
    padded[:len(ids)] = ids
    literals, steps = [], np.empty((block, blocks), dtype=np.int16)
    for b in range(blocks):
        own, steps[:, b] = numbered(padded[b * block:(b + 1) * block])
        literals.append(own)
    model, counts = Trust(blocks), Counts(blocks)
    low, width = np.zeros(blocks, dtype=np.uint64), np.full(blocks, np.uint64(2 ** 64 - 1))
    # A step writes 32 bits at most, and seldom a word for a cut at a carry.
    out = np.zeros((blocks, 3 * block + 8), dtype=np.uint16)
    used = np.zeros(blocks, dtype=np.int64)

    def move(at):
        out[at, used[at]] = low[at] >> _48
        used[at] += 1

    for t, step in enumerate(steps):
        width2, width1 = model.predict()
        hit2 = (model.id2 == step) & (width2 > 0)
        hit1 = (model.id1 == step) & (width1 > 0) & ~hit2
        number = step.astype(np.int32)
        if t:
            both = width2 + width1
            rest = Rest(counts, model, width2, width1)
            unit = ((TOTAL - both).astype(np.uint64) << _16) // rest.total.astype(np.uint64)
            place, amount = rest.find(number)
            start = (both.astype(np.uint64) << _16) + unit * place.astype(np.uint64)
            freq = unit * amount.astype(np.uint64)
            at = np.flatnonzero(hit2 | hit1)
            start[at] = np.where(hit2[at], 0, width2[at]).astype(np.uint64) << _16
            freq[at] = np.where(hit2[at], width2[at], width1[at]).astype(np.uint64) << _16
            part = width >> _32
            low += part * start
            width = part * freq
            settle(low, width, move)
        model.learn(step, hit2, hit1)
        counts.learn(number)
    for k in range(4):
        out[np.arange(blocks), used] = (low >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)
        used += 1
    return literals, [out[b, :n] for b, n in enumerate(used.tolist())]


def decode_blocks(literals: list[np.ndarray], words: list[np.ndarray], n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of consecutive blocks made by ``encode_blocks``."""
    blocks = len(words)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.concatenate([*words, np.zeros(8, dtype=np.uint16)])
    low, width = np.zeros(blocks, dtype=np.uint64), np.full(blocks, np.uint64(2 ** 64 - 1))
    code, at_word = np.zeros(blocks, dtype=np.uint64), np.cumsum(sizes) - sizes

    def move(at):
        code[at] = (code[at] << _16) | flat[np.minimum(at_word[at], len(flat) - 1)]
        at_word[at] += 1

    for _ in range(4):
        move(np.arange(blocks))
    model, counts = Trust(blocks), Counts(blocks)
    out = np.zeros((block, blocks), dtype=np.int16)
    whole = np.uint64(1 << 32)
    for t in range(block):
        width2, width1 = model.predict()
        if t:
            both = width2 + width1
            part = width >> _32
            v = np.minimum((code - low) // part, whole - np.uint64(1))
            v16 = (v >> _16).astype(np.int32)
            hit2, hit = v16 < width2, v16 < both
            start = np.where(hit2, 0, width2).astype(np.uint64) << _16
            freq = np.where(hit2, width2, width1).astype(np.uint64) << _16
            number = np.where(hit2, model.id2, model.id1).astype(np.int32)
            at = np.flatnonzero(~hit)
            base = both[at].astype(np.uint64) << _16
            rest = Rest(counts, model, width2, width1)
            unit = ((TOTAL - both[at]).astype(np.uint64) << _16) // rest.total[at].astype(np.uint64)
            number[at] = rest.number_at(((v[at] - base) // unit).astype(np.int32), at)
            place, amount = rest.find(number[at], at)
            start[at], freq[at] = base + unit * place.astype(np.uint64), unit * amount.astype(np.uint64)
            low += part * start
            width = part * freq
            settle(low, width, move)
        else:
            number, hit2, hit = np.zeros(blocks, np.int32), *np.zeros((2, blocks), bool)
        out[t] = number
        model.learn(out[t], hit2, hit & ~hit2)
        counts.learn(number)
    firsts = np.cumsum([len(x) for x in literals]) - [len(x) for x in literals]
    return np.concatenate(literals)[(out + firsts).T.reshape(-1)[:n]].astype(np.uint32)


def encode_group(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], block: int = BLOCK) -> bytes:
    """One group of the file format; ids lie below 65,536."""
    if len(ids) and int(ids.max()) >= TOTAL:
        raise ValueError("ids must lie below 65536")
    literals, words = encode_blocks(ids, block) if len(ids) else ([], [])
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
                         + np.array(lengths, dtype="<u8").tobytes())
    payloads = [np.concatenate([x, w]).astype("<u2").tobytes() for x, w in zip(literals, words)]
    return b"".join([
        HEAD.pack(MAGIC, VERSION, 0, block, len(ids), len(doc_ids), len(docs), sum(map(len, payloads))), docs,
        np.array([len(x) for x in literals], dtype="<u4").tobytes(), np.array([len(w) for w in words], dtype="<u4").tobytes(),
        np.array([zlib.crc32(p) for p in payloads], dtype="<u4").tobytes(), *payloads])


def read_groups(stream):
    """(ids, document ids, lengths) of each group of a file; damaged blocks raise ValueError."""
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("the file ends inside a group")
        magic, version, _, block, n, n_docs, docs_size, payload_size = HEAD.unpack(head)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token-id file of this version")
        docs = zlib.decompress(stream.read(docs_size))
        known = np.frombuffer(docs, np.uint8, n_docs)
        doc_ids = np.frombuffer(docs, "<i8", n_docs, n_docs)
        lengths = np.frombuffer(docs, "<u8", n_docs, n_docs * 9).astype(np.int64)
        blocks = -(-n // block)
        new, sizes, checks = (np.frombuffer(stream.read(4 * blocks), "<u4").astype(np.int64) for _ in range(3))
        payload = stream.read(payload_size)
        ends = np.cumsum(new + sizes) * 2
        literals, words = [], []
        for b in range(blocks):
            part = payload[ends[b] - 2 * (new[b] + sizes[b]):ends[b]]
            if zlib.crc32(part) != checks[b]:
                raise ValueError(f"block {b} of a group is damaged")
            both = np.frombuffer(part, "<u2")
            literals.append(both[:new[b]])
            words.append(both[new[b]:])
        ids = decode_blocks(literals, words, n, block) if n else np.zeros(0, np.uint32)
        yield ids, [int(d) if k else None for d, k in zip(doc_ids, known)], lengths
