"""Quality, mixing, lines, near duplicates and the pipeline: edge cases and brute force."""

import random
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import pytest

from dwellframe.llm import lines, mixing, neardup, quality
from dwellframe.llm.common import Scratch


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Quality rules

def repeat_words(words, width=8):
    at = defaultdict(list)
    for i in range(len(words) - width + 1):
        at[tuple(words[i:i + width])].append(i)
    return len({i + k for x in at.values() if len(x) > 1 for i in x for k in range(width)})


def test_measures_equal_brute_force(hard_documents):
    got = quality.judge(hard_documents, carry=["doc_id", "text"])
    for r in rows_of(got):
        text = r["text"] or ""
        w = brute.WORDS.findall(text)
        full = [x for x in text.split("\n") if brute.WORDS.search(x)]
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["n_dup_lines"] == len(full) - len(set(full))
        assert r["n_repeat_words"] == repeat_words(w)
        assert r["base_failed"] == (len(w) < 20 or 100 * repeat_words(w) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_overlapping_windows(spark):
    words = "a b c d e f g h a b c d e f g h a b c d e f g h i j k".split()
    text = " ".join(words)
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert quality.judge(df, carry=["doc_id"]).first()["n_repeat_words"] == repeat_words(words) == 24


def test_bad_host_takes_its_documents(spark):
    good = " ".join(f"plain{i}" for i in range(40))
    rows = [(i, good + str(i), f"good{i % 5}") for i in range(200)]
    rows += [(1000 + i, "short" if i % 10 else good, "bad") for i in range(60)]
    rows += [(2000, "short", "tiny"), (2001, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rows_of(quality.judge(df, carry=["doc_id"]))}
    assert all(kept[i] for i in range(200)) and kept[2001]
    assert not any(kept[1000 + i] for i in range(60))
    rates = {r["source"]: r["short_rate"] for r in rows_of(quality.host_verdicts(
        quality.measure(df, carry=["source"]), "source"))}
    assert 0 < rates["tiny"] < 1  # one failure of one document is shrunk towards the corpus


# Mixing

def water_fill(sizes, weights, cap=3.0):
    left, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        share = left / sum(open_.values())
        over = [s for s, w in open_.items() if cap * sizes[s] < share * w]
        if not over:
            return out | {s: min(cap * sizes[s], share * w) for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_targets_and_taken(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), f"s{int(rng.paretovariate(0.7)) % 7}") for i in range(500)]
    rows += [(900 + i, None, "empty") for i in range(5)] + [(None, "a b c", None)] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = rows_of(mixing.mix(df, carry=["doc_id", "source"]))
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: float(i % 3 + 1) for i, s in enumerate(order)})
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["repeats"] <= 3
        taken[r["source"]] += r["m_size"] * r["repeats"]
    for s in sizes:
        if s is not None:
            assert abs(taken[s] - want[s]) <= 60
    again = rows_of(mixing.mix(df.repartition(7), carry=["doc_id", "source"]))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents_repeat_rows(clashing, no_documents):
    taken = mixing.mixed_documents(clashing)
    assert taken.columns == clashing.columns
    assert all(n <= 3 * m for n, m in [(taken.where("doc_id = 8").count(), 1), (taken.where("doc_id = 1").count(), 2)])
    assert mixing.mixed_documents(no_documents).count() == 0


# Line de-duplication

def longest_shared_run(a, b):
    """Most words in a run of equal lines of two texts."""
    x, y = a.split("\n"), b.split("\n")
    best, table = 0, {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            if p == q:
                table[i, j] = table.get((i - 1, j - 1), 0) + len(p.split())
                best = max(best, table[i, j])
    return best


def random_documents(rng, n):
    pool = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(rng.choice([3, 8, 30, 55]))) for _ in range(30)]
    out = []
    for i in range(n):
        own = [" ".join(f"own{i}x{k}y{j}" for j in range(9)) for k in range(rng.randint(0, 6))]
        body = own + rng.sample(pool, rng.randint(0, 8))
        rng.shuffle(body)
        if out and rng.random() < 0.4:
            body += rng.choice(out)[1].split("\n")[: rng.randint(1, 12)]
        out.append((i, "\n".join(body)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_line_blocks_go_from_later_documents_only(spark, seed):
    docs = random_documents(random.Random(seed), 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(lines.dedup_lines(df, min_words=50))}
    first_runs = set()
    for i, text in docs:
        all_lines = text.split("\n")
        gone = {k for s in got[i]["spans"] for k in range(s["first"], s["last"] + 1)}
        assert got[i]["text"] == "\n".join(x for k, x in enumerate(all_lines) if k not in gone)
        # Every deleted line is in an earlier document, and no line goes that is new.
        earlier = {x for j, t in docs if j < i for x in t.split("\n")}
        assert all(all_lines[k] in earlier for k in gone)
        # No run of 50 words or more that an earlier document holds is left whole.
        for k in range(len(all_lines)):
            run, words = [], 0
            for j in range(k, len(all_lines)):
                run.append(all_lines[j])
                words += len(all_lines[j].split())
                if words >= 50:
                    if tuple(run) in first_runs:
                        assert gone & set(range(k, j + 1))
                    break
        for k in range(len(all_lines)):
            words = 0
            for j in range(k, len(all_lines)):
                words += len(all_lines[j].split())
                if words >= 50:
                    first_runs.add(tuple(all_lines[k:j + 1]))
                    break


def test_patience_alignment():
    assert lines.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert lines.patience([1, 1, 2], [1, 2, 1]) in ([(0, 0), (2, 1)], [(0, 0), (1, 2)])
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_line_edge_cases(clashing, no_documents):
    got = lines.dedup_lines(clashing.drop("spans"), min_words=50)
    assert got.columns == [*clashing.drop("spans").columns, "spans"]
    by = defaultdict(list)
    for r in rows_of(got):
        by[r["doc_id"]].append(r["text"])
    assert len(by[1]) == 2 and len(set(by[1])) == 1 and by[1][0]  # repeated rows are one document and the first holder
    assert by[2] == [""] and by[8] == ["x\ny"] and by[3] == [None] and sorted(map(str, by[None])) == ["", "None"]
    assert by[9][0].endswith(" more")
    assert lines.dedup_lines(no_documents).count() == 0


def test_moved_passage_goes_whole():
    p, q = [1, 2, 3, 4], [11, 12, 13, 14, 15]
    later, earlier = q + p, p + q
    gone = lines.repeated_lines(later, [20] * 9, earlier, [20] * 9, 50)
    assert gone == list(range(9))


# Near duplicates

def test_banding_reaches_recall():
    bands, rows = neardup.banding(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999 and bands * rows <= 128


def variants(rng, n_groups, n):
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{rng.randint(0, 500)}" for _ in range(rng.randint(40, 120))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_brute_force(spark, seed):
    texts = variants(random.Random(seed), 8, 25)
    docs = dict(enumerate((i, t) for i, t in enumerate(texts)))
    want, links, sets = brute.near_classes(docs)
    df = spark.createDataFrame(list(docs.values()), "doc_id long, text string")
    members, found = neardup.jaccard_join(df)
    got = {r["doc_id"]: r for r in rows_of(members)}
    # Banding finds a pair at the threshold with probability 0.999 and closer pairs more surely.
    assert sum(got[i]["class_id"] != want[i] for i in want) <= 2
    by_key = {bytes(r["copy_key"]): i for i, r in got.items()}
    linked = Counter()
    for r in rows_of(found):
        a, b = by_key[bytes(r["a"])], by_key[bytes(r["b"])]
        assert len(sets[a] & sets[b]) / len(sets[a] | sets[b]) == pytest.approx(r["similarity"])
        linked[a] += 1
        linked[b] += 1
    linked_twice = {tuple(sorted((bytes(r["a"]), bytes(r["b"])))) for r in rows_of(found)}
    assert len(linked_twice) == found.count() and all(x["n_links"] >= 0 for x in got.values())


@pytest.mark.parametrize("block", [1024, 16])
def test_all_links_of_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = list(dict.fromkeys(variants(random.Random(7), 4, 60)))
    _, links, sets = brute.near_classes({i: (i, t) for i, t in enumerate(texts)})
    assert len(set(sets.values())) == len(texts)
    want = Counter(i for pair in links for i in pair)
    members, found = neardup.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in rows_of(members)}
    by_key = {bytes(r["copy_key"]): i for i, r in got.items()}
    listed = [tuple(sorted((by_key[bytes(r["a"])], by_key[bytes(r["b"])]))) for r in rows_of(found)]
    # Banding finds a pair at the threshold with probability 0.999 and closer pairs more surely.
    assert len(set(listed)) == len(listed) and set(listed) <= {tuple(sorted(x)) for x in links}
    assert len(listed) >= 0.998 * len(links)
    counted = Counter(i for pair in listed for i in pair)
    assert {i: r["n_links"] for i, r in got.items()} == {i: counted[i] for i in got}
    assert sum(want.values()) - sum(r["n_links"] for r in got.values()) <= 0.002 * sum(want.values())


def test_near_duplicate_edge_cases(hard_documents, clashing, no_documents):
    members, _ = neardup.jaccard_join(hard_documents)
    rows = rows_of(members)
    assert len(rows) == hard_documents.count()
    classes = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert classes[1] == classes[2] == classes[9] == 1 and classes[11] == classes[10] == 10
    assert classes[3] == 3 and classes[4] == 4 and classes[5] == 5 and classes[6] == 6
    stay = neardup.one_per_class(clashing)
    assert stay.columns == clashing.columns
    ids = Counter(r["doc_id"] for r in rows_of(stay))
    assert ids[1] == 1 and ids[2] == 0 and ids[9] == 0 and ids[11] == 0 and ids[3] == ids[4] == ids[5] == 1
    assert neardup.one_per_class(no_documents).count() == 0
    assert neardup.jaccard_join(no_documents)[0].count() == 0


def test_components_of_a_chain(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r["key"]: r["label"] for r in rows_of(neardup.components(links, Scratch(spark)))}
    assert all(got[i] == 0 for i in range(n + 1)) and got[101] == 100


# The pipeline

def test_pipeline_stages(spark, documents):
    scratch = Scratch(spark)
    docs, seen = documents, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, scratch.keep(stage(spark, docs, ""), f"stage-{i}")
        seen[i] = (before, docs)
        if i < 4:
            assert docs.columns == documents.columns
    ids = [{r["doc_id"] for r in rows_of(seen[i][1].select("doc_id"))} for i in range(5)]
    judged = quality.judge(documents, carry=["doc_id"])
    assert ids[0] == {r["doc_id"] for r in rows_of(judged) if r["kept"]}
    texts = {r["doc_id"]: r["text"] for r in rows_of(seen[2][0])}
    want, _, _ = brute.near_classes({i: (i, t) for i, t in texts.items()})
    assert ids[2] == set(want.values())
    mixed = Counter(r["doc_id"] for r in rows_of(seen[3][1]))
    plan = {r["doc_id"]: r["repeats"] for r in rows_of(mixing.mix(seen[3][0], carry=["doc_id"]))}
    assert mixed == Counter({i: n for i, n in plan.items() if n})
    pieces = seen[4][1]
    assert ids[4] == set(mixed) and pieces.where("piece = 0").count() == sum(mixed.values())


def test_pipeline_edge_cases(spark, hard_documents, no_documents):
    for docs in (hard_documents, no_documents):
        scratch = Scratch(spark)
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.keep(stage(spark, docs, ""), "edge")
        assert "sequence_id" in docs.columns


def test_quality_edge_cases(clashing, no_documents):
    kept = quality.filter_documents(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in rows_of(kept.select("doc_id"))} <= {None, 1, 2, 6, 8, 9}
    assert quality.filter_documents(no_documents).count() == 0
