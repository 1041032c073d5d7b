"""Packing documents into sequences by a grouping genetic algorithm.

Documents are tokenised, closed with an end id and, where longer than a
sequence, cut into whole sequences behind a shorter first piece. The pieces are
dealt into groups of about ``group_size``; a group is packed by islands that
evolve apart. A packing's genes are its sequences: crossover injects well-filled
sequences of one parent whole into the other, removes the sequences that now
hold a piece twice, and places the displaced pieces by best fit, longest first.
Between epochs the best packing of each island moves to the next island. Pieces
of the emptiest sequences, the under-filled ones among the emptier half, are dealt into
new groups and packed again, until one group is left; so a round repacks at most half
of the sequences, however badly the pieces fit.

A group that reaches the bound ceil(tokens / length) is done; the rest evolve on.

Defined results: a null or empty text is a document of the end id alone;
repeated rows and rows without id are packed each for itself; an empty table
gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellframe.llm import tokens
from dwellframe.llm.common import Scratch

ISLAND = "grp long, island int, size int, packings array<array<int>>, counts array<int>"


def best_fit(bins: list[list[int]], room: list[int], items, sizes: list[int], capacity: int) -> None:
    """Places items, longest first, where the least room is left, and opens bins as needed; changes both lists."""
    spaces = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in sorted(items, key=lambda x: -sizes[x]):
        at = bisect_left(spaces, (sizes[i], -1))
        if at < len(spaces):
            left, b = spaces.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[b] = left - sizes[i]
        if room[b]:
            insort(spaces, (room[b], b))


def rooms(bins: list[list[int]], sizes: list[int], capacity: int) -> list[int]:
    return [capacity - sum(sizes[i] for i in b) for b in bins]


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng,
              well_filled: float = 0.98) -> list[list[int]]:
    """A packing of ``a`` with a random run of the well-filled bins of ``b``."""
    good = [x for x, r in zip(b, rooms(b, sizes, capacity)) if r <= (1 - well_filled) * capacity] or b
    first = int(rng.integers(len(good)))
    injected = good[first:first + 1 + int(rng.integers(max(1, len(good) // 2)))]
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    bins = [list(x) for x in injected] + [list(x) for x in kept]
    best_fit(bins, rooms(bins, sizes, capacity), displaced, sizes, capacity)
    return bins


def mutate(a: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    """Empties the least filled bin and a few random ones and places their pieces again."""
    room = rooms(a, sizes, capacity)
    out = {int(np.argmax(room)), *rng.integers(len(a), size=2 + len(a) // 50).tolist()}
    bins = [list(x) for i, x in enumerate(a) if i not in out]
    best_fit(bins, rooms(bins, sizes, capacity), [i for k in out for i in a[k]], sizes, capacity)
    return bins


def fitness(a: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more unevenly filled ones, which are easier to empty."""
    return -len(a), sum(((capacity - r) / capacity) ** 2 for r in rooms(a, sizes, capacity))


def as_bins(packing) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(packing):
        bins.setdefault(int(b), []).append(i)
    return list(bins.values())


def as_packing(bins: list[list[int]], size: int) -> list[int]:
    out = [0] * size
    for b, x in enumerate(bins):
        for i in x:
            out[i] = b
    return out


def evolve(sizes: list[int], packings, capacity: int, seed: int, population: int, generations: int) -> list[list[list[int]]]:
    """One island's epoch: the population, best first. Stops at the lower bound."""
    rng = np.random.default_rng(seed)
    people = [as_bins(p) for p in packings]
    while len(people) < population:
        # Best fit decreasing, then the same in four waves over noisy sizes.
        noise = np.asarray(sizes) * (1 + (0.05 * rng.standard_normal(len(sizes)) if people else 0))
        bins, room = [], []
        for wave in np.array_split(np.argsort(-noise, kind="stable"), 4 if people else 1):
            best_fit(bins, room, wave.tolist(), sizes, capacity)
        people.append(bins)
    bound = -(-sum(sizes) // capacity)

    def ranked(scored):
        return sorted(scored, key=lambda x: x[0], reverse=True)[:population]

    scored = ranked([(fitness(p, sizes, capacity), p) for p in people])
    for _ in range(generations):
        if -scored[0][0][0] <= bound:
            break
        i, j = rng.integers(len(scored), size=2)
        a, b = scored[min(i, j)][1], scored[max(i, j)][1]
        child = mutate(a, sizes, capacity, rng) if i == j else crossover(a, b, sizes, capacity, rng)
        scored = ranked([*scored, (fitness(child, sizes, capacity), child)])
    return [p for _, p in scored]


def pieces(docs: DataFrame, text: str, carry: Sequence[str], path: str, end_id: int, capacity: int) -> DataFrame:
    """A row per piece: the carried columns as c0, c1, ..., then piece, start, length, ids_crc32."""
    inner = [f"c{i}" for i in range(len(carry))]
    renamed = docs.select(*[F.col(c).alias(i) for c, i in zip(carry, inner)], F.col(text).cast("string").alias("t"))
    own = T.StructType([T.StructField("piece", T.IntegerType()), *[
        T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])

    def cut(batches):
        for batch in batches:
            for part in tokens.text_slices(batch, "t"):
                ids, ends = tokens.encoder(path).encode(part.column("t"))
                rows, out, lo = [], [], 0
                for row, hi in enumerate(ends.tolist()):
                    doc = np.append(ids[lo:hi], ids.dtype.type(end_id))
                    stops = range(len(doc) % capacity or capacity, len(doc) + 1, capacity)
                    for k, stop in enumerate(stops if len(doc) > capacity else [len(doc)]):
                        start = stops[k - 1] if k else 0
                        rows.append(row)
                        out.append((k, start, stop - start, tokens.crc32(doc[start:stop])))
                    lo = hi
                columns = [part.column(c).take(pa.array(rows, pa.int64())) for c in inner]
                made = [pa.array(x, pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(zip(*out))]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*inner, *own.names])

    return renamed.mapInArrow(cut, T.StructType([*renamed.schema.fields[:-1], *own.fields]))


def pack_groups(items: DataFrame, groups: int, capacity: int, scratch: Scratch, islands: int, population: int,
                generations: int, epochs: int) -> DataFrame:
    """(grp, rows, sizes, packing): items (row, size) dealt into groups, each with its best packing."""
    dealt = items.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("grp")).agg(
        F.array_sort(F.collect_list(F.struct("row", "size"))).alias("x"))
    dealt = scratch.keep(dealt.select("grp", F.col("x.row").alias("rows"), F.col("x.size").alias("sizes")), "groups")
    state = None
    for epoch in range(epochs):
        if state is None:
            work = dealt.select("grp", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
                                F.array().cast("array<array<int>>").alias("packings"))
        else:
            # The best of each island goes to the next one; groups at their bound rest.
            moved = state.select("grp", ((F.col("island") + 1) % islands).alias("island"),
                                 F.slice("packings", 1, 1).alias("guest"))
            work = dealt.join(state.join(moved, ["grp", "island"]), "grp").select(
                "grp", "sizes", "island", F.concat("guest", "packings").alias("packings"))

        def run(batches, epoch=epoch):
            for batch in batches:
                out = []
                for x in batch.to_pylist():
                    people = evolve(x["sizes"], x["packings"], capacity, x["grp"] * 1009 + x["island"] * 97 + epoch,
                                    population, generations)
                    out.append({"grp": x["grp"], "island": x["island"], "size": len(x["sizes"]),
                                "packings": [as_packing(p, len(x["sizes"])) for p in people],
                                "counts": [len(p) for p in people]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([
                    ("grp", pa.int64()), ("island", pa.int32()), ("size", pa.int32()),
                    ("packings", pa.list_(pa.list_(pa.int32()))), ("counts", pa.list_(pa.int32()))]))

        spread = work.select("grp", "island", "sizes", "packings").repartition(F.col("grp"), F.col("island"))
        new = scratch.keep(spread.mapInArrow(run, ISLAND), "islands")
        state = new
    best = state.groupBy("grp").agg(F.min(F.struct(F.col("counts")[0].alias("n"), "island", F.col("packings")[0].alias(
        "packing"))).alias("best"))
    return scratch.keep(dealt.join(best, "grp").select("grp", "rows", "sizes", "best.packing"), "packed")


def places(bins: DataFrame) -> DataFrame:
    """(row, sequence_id, offset): a sequence is named by its first row, which no other sequence holds."""
    before = F.aggregate(F.slice("x", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda s, v: s + v["sizes"])
    return bins.select(F.col("x")[0]["rows"].alias("sequence_id"), "x", F.posexplode("x").alias("at", "y")).select(
        F.col("y.rows").alias("row"), "sequence_id", before.alias("offset"))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", carry: Sequence[str] = ("doc_id",), end_id: int = 0,
         capacity: int = 2048, group_size: int = 10_000, islands: int = 3, population: int = 4, generations: int = 12,
         epochs: int = 2, under_filled: float = 0.97) -> DataFrame:
    """A row per piece: the carried columns, piece, start, length, ids_crc32, sequence_id, offset.

    Only carried columns of ``docs`` matter, so others may have any names.
    """
    scratch = Scratch(docs.sparkSession)
    # Row numbers are fixed once written, however often the table is read.
    cut = pieces(docs, text, carry, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id())
    cut = scratch.keep(cut, "pieces")
    full = cut.where(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = cut.where(F.col("length") < capacity).select("row", F.col("length").cast("int").alias("size"))
    placed = full.unionByName(place(items, scratch, capacity, group_size, islands, population, generations, epochs, under_filled))
    out = cut.join(scratch.keep(placed, "places"), "row")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "piece", "start", "length", "ids_crc32",
                      "sequence_id", "offset")


def place(items: DataFrame, scratch: Scratch, capacity: int, group_size: int = 10_000, islands: int = 3, population: int = 4,
          generations: int = 12, epochs: int = 2, under_filled: float = 0.97) -> DataFrame:
    """(row, sequence_id, offset) of items (row, size), each shorter than a sequence."""
    done = [items.sparkSession.createDataFrame([], "row long, sequence_id long, offset long")]
    count = items.count()
    while count:
        groups = -(-count // group_size)
        packed = pack_groups(items, groups, capacity, scratch, islands, population, generations, epochs)
        rows = packed.select("grp", F.explode(F.arrays_zip("rows", "sizes", "packing")).alias("x")).select(
            "grp", "x.*")
        bins = rows.groupBy("grp", "packing").agg(F.array_sort(F.collect_list(F.struct("rows", "sizes"))).alias("x"),
                                                  F.sum("sizes").alias("filled"))
        bins = scratch.keep(bins, "bins")
        if groups == 1:
            done.append(places(bins))
            break
        half = bins.agg(F.percentile_approx("filled", 0.5, 10_000)).first()[0]
        settled = (F.col("filled") >= under_filled * capacity) | (F.col("filled") >= half)
        done.append(places(bins.where(settled)))
        left = bins.where(~settled).select(F.explode("x").alias("y")).select(
            F.col("y.rows").alias("row"), F.col("y.sizes").alias("size"))
        items = scratch.keep(left, "left")
        count = items.count()
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    return placed
