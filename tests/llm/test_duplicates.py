import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import grid_join, lsh_forest, sentence_spans
from tessera.llm.components import components

from .conftest import frame, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def closed(ids, pairs):
    label = {k: k for k in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def mutated(text, share, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randint(0, 10 ** 6)}" for w in text.split())


def test_near_duplicates_match_brute_force(spark, odd_rows, none):
    rows = list(odd_rows)
    for g in range(30):
        text = prose(200 + g, 60 + 10 * g)
        rows += [(100 + 10 * g + k, mutated(text, 0.012 * k, k + g), "a") for k in range(5)]
    # a crowd that shares a passage without links, and a large group of near copies
    passage, copy = prose(90, 60), prose(91, 300)
    rows += [(1000 + k, passage + " " + prose(2000 + k, 70), "b") for k in range(80)]
    rows += [(2000 + k, mutated(copy, 0.004, k), "b") for k in range(80)]
    got = lsh_forest.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sets = {k: shingles(t) for k, (_, t, _) in enumerate(rows)}
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = closed(sets, pairs)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[label[k]] = min((x for x in (least.get(label[k]), i) if x is not None), default=None)
    expected = [(i, len(sets[k]), least[label[k]], i == least[label[k]]) for k, (i, _, _) in enumerate(rows)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(expected, key=str)
    assert lsh_forest.near_duplicates(none).count() == 0


def test_links_inside_a_crowd_are_found(spark):
    """Texts of one template, 15 words of their own each: similarity 56 / 86."""
    def text(t, k, shared=()):
        return " ".join([f"{t}{i}" for i in range(60)] + list(shared) + [f"{t}w{k}x{i}" for i in range(15 - len(shared))])

    rows = [(k, text("t", k), "a") for k in range(20500)]
    rows[700] = (700, text("t", 700, [f"pair{i}" for i in range(6)]), "a")       # with the next: 62 / 80
    rows[20300] = (20300, text("t", 20300, [f"pair{i}" for i in range(6)]), "a")
    # the bare template is similar to each text of its crowd, 56 / 71, which are not to one another
    rows += [(30000 + k, text("u", k), "a") for k in range(1500)] + [(40000, " ".join(f"u{i}" for i in range(60)), "a")]
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(frame(spark, rows)).collect()}
    expected = {i: 700 if i == 20300 else min(i, 30000) for i, _, _ in rows}
    assert len(got) == len(rows) and {i: c for i, c in got.items() if c != expected[i]} == {}


def test_crowd_pairs_match_brute_force(spark):
    rng = random.Random(5)
    sets = []
    for k in range(260):        # parts of a few templates and shingles of few or one
        template = range(1000 * (k % 4), 1000 * (k % 4) + 40)
        own = [100000 + rng.randrange(60) for _ in range(rng.randrange(8))] + [200000 + 100 * k + i for i in range(rng.randrange(12))]
        sets.append(np.unique(np.array([x for x in template if rng.random() > rng.choice([0, 0, 0.06])] + own, dtype="<i8")))
    as_sets = [set(x.tolist()) for x in sets]
    linked = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(as_sets[a] & as_sets[b]) >= 75 * len(as_sets[a] | as_sets[b])]
    frame_ = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long, set binary")
    for rare, block in ((2, 500), (2, 1 << 16), (8, 2000), (32, 500), (1000, 500)):
        pairs = {(r.a, r.b) for r in lsh_forest.crowd_pairs(frame_, (75, 100), rare, block=block).collect()}
        assert closed(range(len(sets)), pairs & set(linked)) == closed(range(len(sets)), linked)


def test_bridges_join_what_all_edges_join():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (30, 12), (60, 400)):
        a, b, component = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, n, n) % (n // 2 + 1)
        held = [(int(x), n + int(c)) for x, c in enumerate(component)]
        some = lsh_forest._bridges(a, b, component)
        assert len(some) < n
        assert closed(range(2 * n), held + list(zip(a[some].tolist(), b[some].tolist()))) \
            == closed(range(2 * n), held + list(zip(a.tolist(), b.tolist())))


@pytest.mark.parametrize("share", [250_000, 100])
def test_components(spark, share, monkeypatch):
    monkeypatch.setattr("tessera.llm.components.SHARE", share)
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(150)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in closed({x for e in edges for x in e}, edges).items() if k in used}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    x = [c + 0.33 * rng.normal(size=24) for c in centres for _ in range(25)] + [rng.normal(size=24) for _ in range(1500)]
    x += [x[0]] * 40 + [x[1] * 3.0] * 3 + [rng.normal(size=5)] * 2
    rows = [(i, [float(v) for v in vec], 0) for i, vec in enumerate(x)]
    rows += [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0), (5003, [None] * 24, 0), (5004, [], 0),
             (5005, [float("inf")] + [0.0] * 23, 0), (None, rows[2][1], 0), (7, rows[7][1], 1)]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in grid_join.near_vectors(frame_).collect()), key=str)
    fit = [k for k, (_, v, _) in enumerate(rows) if v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in fit}
    pairs = [(a, b) for a, b in combinations(fit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    label, links = closed(range(len(rows)), pairs), [0] * len(rows)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[label[k]] = min((v for v in (least.get(label[k]), i) if v is not None), default=None)
    assert len(pairs) > 500
    assert got == sorted(((i, links[k], least[label[k]], i == least[label[k]]) for k, (i, _, _) in enumerate(rows)), key=str)
    assert grid_join.near_vectors(frame_.limit(0)).count() == 0


def test_grid_groups_meet_once():
    for n in range(1, 9):
        met = [frozenset((g, i)) for g in range(n) for i in grid_join.partners(g, n)]
        assert len(met) == len(set(met)) == n * (n + 1) // 2
    assert grid_join.groups_of([(1, 5), (2, 5), (3, 20), (9, 1), (10, 1)], 10) == [(1, 2), (3, 3), (9, 10)]


def test_grid_join_sends_no_block_to_its_partners(spark, monkeypatch):
    """Disk holds each vector a fixed number of times, however many blocks meet, and groups change nothing."""
    from pathlib import Path

    x = np.random.default_rng(5).normal(size=(600, 8))
    x[300:400] = x[:100] + 0.01
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = closed(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    monkeypatch.setattr(grid_join, "BLOCK", 32)
    for most in (1, 32 * 8 * 8 * 3, 1 << 20):
        monkeypatch.setattr(grid_join, "GROUP_BYTES", most)
        plans, joined = [], grid_join._joined
        with monkeypatch.context() as m:
            m.setattr(grid_join, "_joined", lambda blocks, *args: plans.append((blocks, found := joined(blocks, *args))) or found)
            got = {r.vec_id: r for r in grid_join.near_vectors(vectors).collect()}
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (int(near[i].sum()) - 1, label[i]) for i in range(len(x))}
        (blocks, found), = plans
        assert blocks.count() > 15 and all(Path(f.removeprefix("file:")).stat().st_size < 50_000 for f in found.inputFiles())
        assert set(found.columns) == {"kind", "a", "b"} and found.count() < 40 * len(x)


def test_sentence_spans(spark, odd_rows, none):
    shared = "This passage has a good number of words in it. It goes on for a second sentence of some length. And it ends here."
    rows = odd_rows + [(50, prose(70, 40) + "\n" + shared + "\n" + prose(71, 40), "a"), (51, shared, "a"),
                       (52, prose(72, 30) + "\n" + shared + "\nThe own tail stays.", "a"), (53, "Short one. Short two. Short three.", "a"),
                       (54, "Short one. Short two. Short three.", "a")]
    got = sentence_spans.repeated_sentences(frame(spark, rows)).collect()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, expected = set(), []
    for k in order:
        parts = [rows[k][1][a:b].lower().split() for a, b in sentence_spans.sentences(rows[k][1] or "")] if rows[k][1] else []
        gone = set()
        for s in range(len(parts)):
            for e in range(s + 1, len(parts) + 1):
                n = sum(map(len, parts[s:e]))
                if n >= sentence_spans.MIN_WORDS and e - s >= sentence_spans.SEVERAL or n >= sentence_spans.ALONE_WORDS:
                    key = tuple(map(tuple, parts[s:e]))
                    gone |= set(range(s, e)) if key in seen else set()
                    seen.add(key)
                    break
        expected.append((rows[k][0], len(parts), len(gone)))
    assert sorted(((r.doc_id, r.n_sentences, sum(s.end - s.start for s in r.removed)) for r in got), key=str) == sorted(expected, key=str)
    texts = {r.doc_id: r.text for r in sentence_spans.remove_repeated(frame(spark, rows)).where("doc_id >= 50").collect()}
    assert shared in texts[50] and texts[51] == "" and texts[52].endswith("The own tail stays.") and shared not in texts[52]
    assert texts[53] == texts[54]
    assert sentence_spans.repeated_sentences(none).where(F.size("removed") > 0).count() == 0
