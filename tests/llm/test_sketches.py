"""Bottom-k fingerprints against sets of shingles."""

import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwellframe.llm import sketches


def whole(text, width=5):
    """All shingle hashes of a text, ascending, one by one."""
    out = set()
    for s in brute.shingles(text, width):
        x = len(s) * sketches.LENGTH_FACTOR + sum(sketches.word_hash(w) * f for w, f in zip(s, sketches.FACTORS))
        x %= 2 ** 64
        x = (x ^ (x >> 32)) * sketches.MIX % 2 ** 64
        out.add(x ^ (x >> 29))
    return sorted(out)


def likeness(a, b, k=sketches.SIZE):
    both = sorted({*a, *b})[:k]
    return sum(x in set(a) and x in set(b) for x in both) / len(both) if both else 1.0


def brute_rows(rows):
    """compare_edits, one document after the other."""
    rows = sorted(((d is None, -(d or 0), hashlib.md5((t or "").encode()).hexdigest(), d, t or "") for d, t in rows), key=lambda r: r[:3])
    out = []
    for i, (_, _, _, d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][4], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, n = ([x for x in whole(v)] for v in (t, edited, after))
        text = ["".join(f"{x:016x}" for x in s[:sketches.SIZE]) for s in (a, b)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *text, likeness(a, b), likeness(a, n)))
    return out


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 2000])
def test_equals_brute_force(spark, hard_documents, monkeypatch, bucket_bytes):
    monkeypatch.setattr(sketches, "BUCKET_BYTES", bucket_bytes)
    got = [tuple(r) for r in sketches.compare_edits(hard_documents).collect()]
    want = brute_rows([(r["doc_id"], r["text"]) for r in hard_documents.collect()])
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_clashing_columns_one_document_and_none(spark, clashing, hard_documents, no_documents):
    got = sketches.compare_edits(clashing).collect()
    assert sorted(map(str, got)) == sorted(map(str, sketches.compare_edits(hard_documents).collect()))
    assert sketches.compare_edits(no_documents).count() == 0
    [one] = sketches.compare_edits(hard_documents.where("doc_id = 10")).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b ca b ").hexdigest()
    assert sketches.fingerprints(no_documents).count() == 0


def test_fingerprints_of_parts_and_groups(spark, hard_documents, monkeypatch):
    want = {r["doc_id"]: r["fingerprint"] for r in sketches.compare_edits(hard_documents).collect()}
    monkeypatch.setattr(sketches, "PART_WORDS", 7)
    for got in sketches.fingerprints(hard_documents.where("doc_id <> 7")).collect():
        assert got["fingerprint"] == want[got["doc_id"]]
    rows = hard_documents.select("source", "text").collect()
    for parts in (1, 512):
        groups = {r["group"]: r for r in sketches.group_fingerprints(hard_documents, "source", parts=parts).collect()}
        assert set(groups) == {r["source"] for r in rows}
        for g, r in groups.items():
            every = sorted({x for s, t in rows if s == g for x in whole(t)})
            assert r["fingerprint"] == "".join(f"{x:016x}" for x in every[:sketches.SIZE])
            assert r["n_shingles"] == pytest.approx(len(every), rel=0.2)


def test_estimates():
    rng = random.Random(5)
    for _ in range(20):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
        cut = rng.randint(0, 3000)
        a, b = " ".join(words), " ".join(words[:cut] + [f"v{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 3000))])
        sa, sb = (set(whole(x)) for x in (a, b))
        x, y = sketches.sketch_texts(pa.array([a, b]))
        assert abs(sketches.resemblance(x, y) - len(sa & sb) / len(sa | sb)) < 0.12
        assert abs(sketches.containment(x, y) - len(sa & sb) / len(sa)) < 0.2
        assert sketches.distinct(x) == pytest.approx(len(sa), rel=0.25)
        assert (sketches.merge(x, y) == np.array(sorted(sa | sb)[:sketches.SIZE], dtype=np.uint64)).all()


def test_equal_texts_have_equal_fingerprints(spark, documents):
    doubled = documents.select("doc_id", "text").union(documents.select(F.col("doc_id") + 10**6, "text"))
    got = {r["doc_id"]: r["fingerprint"] for r in sketches.compare_edits(doubled).collect()}
    assert all(got[d] == got[d + 10**6] for d in got if d < 10**6)
