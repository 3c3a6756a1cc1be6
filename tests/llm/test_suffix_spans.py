import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_spans

from .conftest import frame, prose


def brute_force(rows, length):
    """(doc_id, n_bytes, spans, kept) of each row."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = {i: (-1 if i is None else i) for i, _ in texts}
    least: dict = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            w = t[k:k + length]
            least[w] = min(least.get(w, 1 << 62), order[i])
    out = Counter()
    for i, t in texts:
        gone = set()
        for k in range(len(t) - length + 1):
            if least[t[k:k + length]] < order[i]:
                gone.update(range(k, k + length))
        edges = [k for k in range(len(t) + 1) if (k in gone) != (k - 1 in gone)]
        out[i, len(t), tuple(zip(edges[::2], edges[1::2])), bytes(c for k, c in enumerate(t) if k not in gone)] += 1
    return out


def planted():
    rng = random.Random(9)
    passage = prose(701, 90)
    rows = [(100 + k, prose(710 + k, rng.randint(3, 60)) + " " + passage[rng.randint(0, 60):] + prose(810 + k, rng.randint(1, 20))) for k in range(25)]
    rows += [(200 + k, prose(720, 200) + f" {k}") for k in range(8)]             # near copies
    rows += [(300, "ab" * 300), (301, "ab" * 40), (302, "ab" * 24 + "a"), (303, "a" * 500), (304, "a" * 50), (305, "a" * 49), (306, "é" * 200)]
    return rows


def found(table, **more):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffix_spans.remove_repeats(table, **more).collect())


@pytest.mark.parametrize("more", [{}, {"block_bytes": 900, "bucket_bytes": 2000}, {"block_bytes": 900, "hot_blocks": 1}, {"length": 21, "block_bytes": 900}])
def test_spans_match_brute_force(spark, odd_rows, more):
    rows = planted() + [(i, t) for i, t, _ in odd_rows if i != 9] + [(9, prose(3, 4000))]
    assert found(frame(spark, [(i, t, "a") for i, t in rows]), **more) == brute_force(rows, more.get("length", 50))


def test_empty_table(none):
    assert suffix_spans.remove_repeats(none).count() == 0


def test_pieces_are_joined(monkeypatch, spark):
    rows = planted()
    monkeypatch.setattr(suffix_spans, "PIECE", 64)
    text = "".join(t for _, t in rows).encode()
    data = np.frombuffer(text, np.uint8)
    small = suffix_spans.anchors(data, np.array([0, 500]))
    monkeypatch.undo()
    assert small.tolist() == suffix_spans.anchors(data, np.array([0, 500])).tolist()


@pytest.mark.parametrize("base", [suffix_spans.BASE, 1])
def test_classes_are_equal_strings(base):
    """With base 1 a hash is a sum of bytes: most hashes collide."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.permutation(len(data) - 12)
    group = np.array([int(data[s]) for s in starts])
    classes = suffix_spans.equal_strings(data, starts, group, 12, base)
    strings = [bytes(data[s:s + 12]) for s in starts]
    assert len(set(zip(strings, classes.tolist()))) == len(set(strings)) == len(set(classes.tolist()))


def test_suffixes_come_in_order():
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = rng.permutation(len(data) - 30)
    order = suffix_spans.merge_sorted(suffix_spans.Prefixes(data), data, starts, np.zeros(len(starts), np.int64), 30)
    assert [bytes(data[s:s + 30]) for s in starts[order]] == sorted(bytes(data[s:s + 30]) for s in starts)
