"""Token ids of whole texts, by the tokenizers library, in Arrow batches.

Byte-level BPE never merges across the start of a word, so a text is cut before
the blanks that start words, each distinct piece is encoded once per worker,
and the ids of a text are gathered from its pieces. Texts in which a blank
stands between other white space, or after some at the end, are encoded whole,
and so are those that hold the string of a special token, which is that token's
id unless it is asked to be ordinary text.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES = 250_000  # pieces of a generation; a worker keeps two, and pieces in use pass from the old to the new
RUN = 100  # new pieces encoded as one text: fewer calls' results than one by one, and no long ones
BATCH_BYTES = 8 << 20  # text encoded at once
# A blank after white space, by any definition of it, and before more or the end.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_ODD = rf"{_WHITE} (?:{_WHITE}|\z)"
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _literal(text: str) -> str:
    """A pattern for just that text."""
    return "".join(c if c.isalnum() or ord(c) > 127 else rf"\x{{{ord(c):x}}}" for c in text)


class Encoder:
    def __init__(self, path: str, plain_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_text  # the strings of special tokens are ordinary text
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_text and t.special))
        self.odd = "|".join([_ODD, *map(_literal, added)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        # Byte-level: a character of a token's name is a byte of text.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that each begin with a blank and the start of a word, ``RUN`` pieces encoded as one text.

        Their ids are told apart by the bytes that each id stands for.
        """
        found = self._encode(["".join(pieces[lo:lo + RUN]) for lo in range(0, len(pieces), RUN)])
        flat = np.fromiter(chain.from_iterable(found), self.dtype, sum(map(len, found)))
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        token_ends = np.cumsum(self.widths[flat])
        cuts = np.searchsorted(token_ends, ends)
        if len(flat) != cuts[-1] + 1 or (token_ends[cuts] != ends).any():
            return self._alone(pieces)
        raw, cuts = flat.tobytes(), ((cuts + 1) * flat.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    def _alone(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x, dtype=self.dtype).tobytes() for x in self._encode(pieces)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces as bytes; a piece is given without its blank, and the first of a text with one."""
        if len(self.new) > PIECES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, pieces))
        words, others = [], []
        for i, x in enumerate(out):
            if x is not None:
                continue
            piece = pieces[i]
            known = old.get(piece)
            if known is not None:
                new[piece] = out[i] = known
            elif piece and not piece[0].isspace():
                words.append(i)
            else:
                others.append(i)
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            for i, ids in zip(part, self._joined([" " + pieces[i] for i in part])):
                new[pieces[i]] = out[i] = ids
        for lo in range(0, len(others), 20_000):
            part = others[lo:lo + 20_000]
            for i, ids in zip(part, self._alone([p[1:] if p[:1] == " " else " " + p for p in map(pieces.__getitem__, part)])):
                new[pieces[i]] = out[i] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, their ends); null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        whole = dict(zip(odd.tolist(), self._encode(texts.take(pa.array(odd)).to_pylist()))) if len(odd) else {}
        if whole:
            mask = np.zeros(len(texts), dtype=bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = parts.flatten().dictionary_encode()
        # Joined and split again, which is faster than making the strings one by one; no piece holds a blank.
        own = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(own)], own), pa.scalar(" ", pa.large_string()))[0].as_py()
        pieces = joined.split(" ") if len(own) else []
        codes = coded.indices.to_numpy()
        firsts = offsets[:-1]
        lead = np.unique(codes[firsts]) if len(firsts) else np.empty(0, dtype=np.int64)
        own = pa.array(self._pieces(pieces + [" " + pieces[i] for i in lead]), pa.large_binary())
        at_lead = np.zeros(len(pieces), dtype=codes.dtype)
        at_lead[lead] = len(pieces) + np.arange(len(lead))
        slots = codes.copy()
        slots[firsts] = at_lead[codes[firsts]]
        found = own.take(pa.array(slots))
        ends = np.frombuffer(found.buffers()[1], np.int64, len(found) + 1) // self.dtype().itemsize
        ids = np.frombuffer(found.buffers()[2] or b"", self.dtype, int(ends[-1]))
        text_ends = ends[offsets[1:]]
        if whole:
            return _insert(ids, text_ends, whole, self.dtype)
        return ids, text_ends


def _insert(ids, ends, whole, dtype):
    out, lo, sizes = [], 0, []
    for i, hi in enumerate(ends.tolist()):
        part = np.array(whole[i], dtype=dtype) if i in whole else ids[lo:hi]
        out.append(part)
        sizes.append(len(part))
        lo = hi
    return np.concatenate(out), np.cumsum(sizes)


def encoder(path: str, plain_text: bool = False) -> Encoder:
    """The worker's encoder of that file; it keeps its pieces between tasks."""
    if (path, plain_text) not in _ENCODERS:
        _ENCODERS[path, plain_text] = Encoder(path, plain_text)
    return _ENCODERS[path, plain_text]


def text_slices(batch: pa.RecordBatch, text: str, most: int | None = None):
    """Parts of a batch with at most ``most`` bytes of text (``BATCH_BYTES`` if not said), or one row."""
    most = most or BATCH_BYTES
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(lo, hi - lo)
        # What the last part needed goes back to the system: workers share a small executor with the JVM.
        pa.default_memory_pool().release_unused()
        lo = hi


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
