"""Alignment of two tokenizers' ids over the same bytes, with an identity map as fast path.

A text with a space before it is cut into segments before blanks that follow
no white space; neither tokenizer merges across such a blank, so a distinct
segment is encoded and aligned once per worker. Byte offsets where tokens of
both end cut a segment into groups; the tokens that end a group together are
linked. An array from every id of A to the id of B with the same bytes tells
the regular groups: one token each, with the same bytes. Their links are
counted in a vector over the vocabulary of A, of which a task emits what is
not zero. Only links of irregular groups are counted as pairs, once per block
of documents before the shuffle, and come back to their block with
corpus-wide counts.

Defined results: a null or empty text, or one whose tokens' bytes are not the
text's (U+2581 in it), has no tokens: zeros and ''; repeated rows count each;
an empty table gives an empty table; columns other than those named play no
part; blocks end with 4 MB of text, so a very long text is one of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellframe.llm import tokens
from dwellframe.llm.common import Scratch

CUT = re.compile(r" (?<=\S )")  # a blank after no white space
KEPT, KEPT_LETTERS = 100_000, 64  # segments of a generation, of which a worker keeps two, and their length
STEP = 20_000  # segments encoded at once
BLOCK_BYTES = 4 << 20  # text of a block
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where visible, else the next from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.bytes_a = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in names]
        self.bytes_b, same = [], {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            single = self.b.is_byte(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if single else piece.replace("▁", " ").encode())
            if not (self.b.is_control(i) or self.b.is_unknown(i) or (single and self.bytes_b[i] in same)):
                same[self.bytes_b[i]] = i
        self.same = np.array([same.get(x, -1) for x in self.bytes_a], np.int64)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.text_a, self.text_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        self.new: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def _align(self, segments: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, groups as text, ids of regular links, pairs of irregular ones); None where bytes differ."""
        own_a = [e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)]
        own_b = [x or [self.blank] for x in self.b.encode(segments, num_threads=1)]
        true = [b" " + s.encode() for s in segments]
        good = [b"".join([self.bytes_a[i] for i in x]) == t == b"".join([self.bytes_b[i] for i in y])
                for x, y, t in zip(own_a, own_b, true)]
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x for x, ok in zip(own, good) if ok), np.int64) for own in (own_a, own_b))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        at_a, at_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        last_a, last_b = flat_a[at_a], flat_b[at_b]
        regular = (np.diff(at_a, prepend=-1) == 1) & (np.diff(at_b, prepend=-1) == 1) & (self.same[last_a] == last_b)
        pairs = (last_a.astype(np.uint64) << np.uint64(32)) | last_b.astype(np.uint64)
        sizes = np.fromiter((len(t) for t, ok in zip(true, good) if ok), np.int64)
        ends = np.searchsorted(both, np.cumsum(sizes), side="right").tolist()
        names_a, names_b = [self.text_a[i] for i in flat_a.tolist()], [self.text_b[i] for i in flat_b.tolist()]
        groups = [",".join(names_a[i:k]) + "|" + ",".join(names_b[j:m]) for i, k, j, m in zip(
            [0, *(at_a + 1).tolist()], (at_a + 1).tolist(), [0, *(at_b + 1).tolist()], (at_b + 1).tolist())]
        out, lo, each = [], 0, iter(ends)
        for x, y, ok in zip(own_a, own_b, good):
            if not ok:
                out.append(None)
                continue
            hi = next(each)
            plain = regular[lo:hi]
            out.append((len(x), len(y), hi - lo, ";".join(groups[lo:hi]), last_a[lo:hi][plain].astype(np.uint32).tobytes(),
                        pairs[lo:hi][~plain].tobytes()))
            lo = hi
        return out

    def records(self, segments: list[str]) -> list[tuple | None]:
        """The alignment of distinct segments; short ones stay for later batches."""
        if len(self.new) > KEPT:
            self.old, self.new = self.new, {}
        out, unknown = [None] * len(segments), []
        for i, s in enumerate(segments):
            if s in self.new:
                out[i] = self.new[s]
            elif s in self.old:
                out[i] = self.new[s] = self.old[s]
            else:
                unknown.append(i)
        for lo in range(0, len(unknown), STEP):
            part = unknown[lo:lo + STEP]
            for i, found in zip(part, self._align([segments[i] for i in part])):
                out[i] = found
                if len(segments[i]) <= KEPT_LETTERS:
                    self.new[segments[i]] = found
        return out

    def block(self, texts: list[str | None], digest: bool) -> dict:
        """Per document: token, group and link counts, its groups (or their sha256), regular ids and irregular pairs, end to end."""
        cut = [CUT.split(t) if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(cut), pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        own = self.records(coded.dictionary.to_pylist())
        bad = np.fromiter((r is None for r in own), bool, len(own))
        own = [r or (0, 0, 0, "", b"", b"") for r in own]
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        starts = np.concatenate([[0], ends[:-1]])
        wrong = np.concatenate([[0], np.cumsum(bad[codes])])
        fine = wrong[ends] == wrong[starts]
        doc = np.repeat(np.arange(len(cut)), ends - starts)
        used = fine[doc]
        doc, used_codes = doc[used], codes[used]
        out = {"ok": fine & (ends > starts)}
        for name, k in (("n_a", 0), ("n_b", 1), ("n_groups", 2)):
            size = np.fromiter((r[k] for r in own), np.int64, len(own))
            total = np.concatenate([[0], np.cumsum(np.where(used, size[codes], 0))])
            out[name] = total[ends] - total[starts]
        listed = codes.tolist()
        groups = [r[3] for r in own]
        out["groups"] = [";".join(map(groups.__getitem__, listed[a:b])) if ok else "" for ok, a, b in zip(out["ok"], starts.tolist(), ends.tolist())]
        if digest:
            out["groups"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in out["groups"]]
        for name, k, kind in (("regular", 4, np.uint32), ("irregular", 5, np.uint64)):
            pool = np.frombuffer(b"".join(r[k] for r in own), kind)
            size = np.fromiter((len(r[k]) for r in own), np.int64, len(own)) // np.dtype(kind).itemsize
            first = np.cumsum(size) - size
            each = size[used_codes]
            stop = np.cumsum(each)
            out[name] = pool[np.repeat(first[used_codes] - (stop - each), each) + np.arange(int(each.sum()))]
            out[f"{name}_ends"] = np.cumsum(np.bincount(doc, weights=each, minlength=len(cut)).astype(np.int64))
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of the two files; it keeps its segments between tasks."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per document from values that lie end to end."""
    offsets = np.concatenate([[0], ends]) * values.dtype.itemsize
    if offsets[-1] >= 2 ** 31:
        raise ValueError("a block of more than 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def _numbers(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The inverse: (values end to end, ends)."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // np.dtype(kind).itemsize


def _aligned_blocks(rows: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """Kind 0: documents with their links; 1: a block's irregular pairs, counted; 2: a task's regular links by id of A."""
    carry = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    fields = [("kind", "int"), ("block", "long"), *(c.split(" ", 1) for c in carry), ("n_a", "long"), ("n_b", "long"),
              ("n_groups", "long"), ("groups", "string"), ("regular", "binary"), ("irregular", "binary"), ("idx", "int"),
              ("a", "int"), ("b", "int"), ("n", "long")]
    schema = ", ".join(f"{n} {t}" for n, t in fields)
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        own = aligner(path_a, path_b)
        regular = np.zeros(len(own.same), np.int64)
        kinds = {n: types.get(t) for n, t in fields}
        number = TaskContext.get().partitionId() << 32

        def rows_of(size: int, kind: int, **columns) -> pa.RecordBatch:
            columns = columns | {"kind": pa.array(np.full(size, kind, np.int32)), "block": pa.array(np.full(size, number))}
            return pa.RecordBatch.from_arrays([columns[n] if n in columns else pa.nulls(size, t) for n, t in kinds.items()],
                                              names=list(kinds))

        for batch in batches:
            kinds |= {n: batch.schema.field(n).type for n in batch.schema.names[:-1]}
            for part in tokens.text_slices(batch, "t", BLOCK_BYTES):
                x = own.block(part.column("t").to_pylist(), digest)
                regular += np.bincount(x["regular"], minlength=len(regular))
                pairs, index, count = np.unique(x["irregular"], return_inverse=True, return_counts=True)
                yield rows_of(
                    len(part), 0, **{n: part.column(n) for n in part.schema.names[:-1]},
                    **{n: pa.array(x[n]) for n in ("n_a", "n_b", "n_groups")}, groups=pa.array(x["groups"], pa.string()),
                    regular=_binary(x["regular"], x["regular_ends"]),
                    irregular=_binary(index.ravel().astype(np.uint32), x["irregular_ends"]))
                yield rows_of(len(pairs), 1, idx=pa.array(np.arange(len(pairs), dtype=np.int32)), n=pa.array(count.astype(np.int64)),
                              a=pa.array((pairs >> np.uint64(32)).astype(np.int32)), b=pa.array((pairs & np.uint64(2 ** 32 - 1)).astype(np.int32)))
                number += 1
        seen = np.flatnonzero(regular)
        if len(seen):
            yield rows_of(len(seen), 2, a=pa.array(seen.astype(np.int32)), b=pa.array(own.same[seen].astype(np.int32)),
                          n=pa.array(regular[seen]))

    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, text: str = "text", carry: Sequence[str] = ("doc_id",),
          digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of a byte-level tokenizer A and a sentencepiece model B.

    Documents: the carried columns, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    linked most often of all with its id of B), count_sum (their pairs' counts) and groups as 'a1,a2|b1;a3|b2,b3', or their
    sha256 with ``digest`` (groups are longer than the text). Pairs: a, b, n and best for every linked pair of ids.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).cast("string").alias("t"))
    held = scratch.keep(_aligned_blocks(rows, tokenizer_a, tokenizer_b, digest), "aligned")
    counts = scratch.keep(held.where("kind > 0").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "link-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("high"))  # a row per id of B at most
    pairs = scratch.keep(counts.join(F.broadcast(highest), "b").select(
        "kind", "a", "b", "n", (F.col("n") == F.col("high")).alias("best")), "link-pairs")
    # A row per id of A at most.
    regular = pairs.where("kind = 2").select("a", "n", "best").toArrow()
    ids = regular.column("a").to_numpy()
    count, best = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int64), np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    count[ids], best[ids] = regular.column("n").to_numpy(), regular.column("best").to_numpy()
    vectors = spark.sparkContext.broadcast((count, best))
    back = held.where("kind = 1").select("block", "idx", "a", "b").join(
        pairs.where("kind = 1").select("a", "b", "n", "best"), ["a", "b"]).select(
        F.col("block").alias("to_block"), "idx", "n", "best")
    names = [f"c{i}" for i in range(len(carry))]
    mine = held.where("kind = 0").select("block", *names, "n_a", "n_b", "n_groups", "groups", "regular", "irregular")
    kept = [f"{n} {mine.schema[n].dataType.simpleString()}" for n in names]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        idx = right.column("idx").to_numpy()
        own_n, own_best = np.zeros(len(idx), np.int64), np.zeros(len(idx), bool)
        own_n[idx], own_best[idx] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sums, bests = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for name, kind, n, top in (("regular", np.uint32, *vectors.value), ("irregular", np.uint32, own_n, own_best)):
            at, ends = _numbers(left.column(name), kind)
            for out, values in ((sums, n), (bests, top)):
                total = np.concatenate([[0], np.cumsum(values[at], dtype=np.int64)])
                out += total[ends] - total[np.concatenate([[0], ends[:-1]])]
        return left.select([*names, "n_a", "n_b", "n_groups", "groups"]).append_column("n_best", pa.array(bests)).append_column(
            "count_sum", pa.array(sums))

    done = mine.groupBy("block").cogroup(back.groupBy("to_block")).applyInArrow(
        summed, ", ".join([*kept, "n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long"]))
    # The last tokens of a group are its only ones that end together.
    documents = done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_a", "n_b", "n_groups",
                            F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
    return documents, pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
