import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_crf, mixing
from tessera.llm.common import words_of

from .conftest import frame, prose


def test_scores_of_texts(spark, odd_rows, none):
    rows = odd_rows + [(100 + k, prose(k % 5, 120), "a") for k in range(60)]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows}
    counts = Counter()
    for i, text, _ in rows:
        if not held[i]:
            counts.update([*(text or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for i, text, _ in rows:
        words = [*(text or "").encode().lower().split(), b""]
        expected.append((i, held[i], len(words), sum(counts[w] > 0 for w in words), n,
                         round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 6)))
    got = mixing.score_texts(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    fresh = [r for r in got if r.held_out and r.n_tokens > 50]
    assert fresh and sum(r.score for r in fresh) > sum(r.base_score for r in fresh)
    assert mixing.score_texts(none).count() == 0


def test_rare_words_by_join_alone(spark, odd_rows, monkeypatch):
    rows = [r for r in odd_rows if r[0] != 9] + [(100 + k, prose(k, 50), "a") for k in range(20)]
    plain = {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in mixing.score_texts(frame(spark, rows)).collect()}
    monkeypatch.setattr(mixing, "HOT_WORDS", 3)
    assert {(r.doc_id, r.n_tokens): round(r.base_score, 6) for r in mixing.score_texts(frame(spark, rows)).collect()} == plain


def test_probabilities_add_up_to_one():
    """All symbols that may follow a prefix share its probability."""
    words = [b"the", b"then", b"thorn", b"of", b""]
    counts, scripts = np.array([9, 3, 1, 5, 4]), np.zeros(5, np.int32)
    hist = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
    tree = mixing.huffman(hist)
    table = np.zeros((mixing._OFFSETS[-1], 2), np.int64)
    mixing.add_words(table, words, scripts, counts, tree, 1)
    learner = mixing.Learner()
    for _ in range(5):
        learner.step(words, scripts, counts.astype(float), tree, mixing._scaled(table))
    model = mixing.Model(tree, learner.w.astype(np.float32), np.zeros(16), mixing._scaled(table))
    nodes = {}
    for byte in range(256):
        path = [int(x) for x in tree.node[tree.first[byte]:tree.first[byte] + tree.length[byte]]]
        bits = tree.bit[tree.first[byte]:tree.first[byte] + tree.length[byte]].tolist()
        nodes[tuple(zip(path, bits))] = byte
    assert len(nodes) == 256 and sum(2.0 ** -int(k) for k in tree.length) == pytest.approx(1)
    slots, bit, begins, n = mixing.word_bits([bytes([b]) for b in range(256) if b != 32], np.zeros(255, np.int32), tree)
    x, gate = mixing.features(slots, bit, begins, model.table, False)
    first = np.cumsum(n) - n
    total = 0.0
    for k, b in enumerate(b for b in range(256) if b != 32):
        at = slice(first[k], first[k] + tree.length[b])
        z = (x[at] * model.weights[0][gate[at]]).sum(axis=1) * (2 * bit[at] - 1)
        total += np.exp(-np.log1p(np.exp(-z))).prod()
    space = slice(first[0] + tree.length[0], first[0] + n[0])      # a space may also begin a word's place
    assert 0.5 < total <= 1.0 + 1e-5 and space.stop > space.start


def test_whole_word_contexts_of_all_words(spark):
    """Words seen twice, more than a table of frequent words holds, are known as whole words."""
    rng = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (100_000, 9))]
    rows = [(k + more, " ".join(words[k * 100:(k + 1) * 100]), "a") for k in range(1000) for more in (0, 5000)]
    per_word = [r.score / r.n_tokens for r in mixing.score_texts(frame(spark, rows)).collect() if not r.held_out]
    assert sum(per_word) / len(per_word) > -11.0      # letters alone: 9 * log10(26) = 12.7


def test_words_in_another_order_score_worse(spark):
    """What follows what counts: training texts hold pairs that their words in another order do not make."""
    texts = [prose(k, 60) for k in range(40)]
    held = [k for k in range(1000, 1100) if zlib.crc32(str(k).encode()) % mixing.MODULUS == 0][:2]
    other = " ".join(random.Random(0).sample(texts[0].split(), len(texts[0].split())))
    rows = [(k, t, "a") for k, t in enumerate(texts)] + [(held[0], texts[0], "a"), (held[1], other, "a")]
    got = {r.doc_id: r for r in mixing.score_texts(frame(spark, rows)).collect()}
    one, two = got[held[0]], got[held[1]]
    assert one.held_out and two.held_out and one.n_tokens == two.n_tokens and one.score > two.score + 5


def test_pairs_are_counted_over_training_texts(spark, monkeypatch):
    """The number of every pair of a slice, however the hashes are cut, and its share in the score."""
    assert len(set(mixing.pair_keys(mixing.word_keys([b"a", b"b", b"a", b"ab", b""]), np.array([0])).tolist())) == 5
    for x in (np.arange(1000, dtype=np.uint64) ** 5, np.zeros(0, np.uint32), np.array([-1, 7, 1 << 20], np.int32)):
        assert (mixing.unpacked(mixing.packed(x), x.dtype.str) == x).all()
    rows = [(k, t, "a") for k, t in enumerate(["a b a b c", "b a", "", None, "c a b"] * 5)]
    expected = Counter()
    for k, t, _ in rows:
        words = ["<", *(t or "").split(), ">"]
        if zlib.crc32(str(k).encode()) % mixing.MODULUS:
            expected.update(zip(words, words[1:]))
    found, scores, inner = [], [], mixing._pair_numbers
    for most, text_bytes in ((mixing.PART_TOKENS, mixing.TEXT_BYTES), (2, 40)):
        monkeypatch.setattr(mixing, "PART_TOKENS", most)
        monkeypatch.setattr(mixing, "TEXT_BYTES", text_bytes)
        monkeypatch.setattr(mixing, "_pair_numbers", lambda *args: found.append(inner(*args)) or found[-1])
        scores.append(sorted((r.doc_id, round(r.score, 9)) for r in mixing.score_texts(frame(spark, rows)).collect()))
        numbers = {n for r in found.pop().collect() for n in mixing.unpacked(bytes(r.n), "u8").tolist()}
        assert numbers - {0} == set(expected.values())
    assert scores[0] == scores[1]


def test_pages_know_what_others_hold():
    """Counts of every context are those of the whole vocabulary, however it is cut."""
    rng = np.random.default_rng(1)
    words = sorted({b""} | {bytes(rng.integers(97, 100, rng.integers(1, 7)).astype(np.uint8)) for _ in range(300)})
    scripts, counts = np.zeros(len(words), np.int32), rng.integers(0, 9, len(words))
    tree = mixing.huffman(np.ones(256))
    cuts = [(a, min(a + 7, len(words))) for a in range(0, len(words), 7)]
    met = {}
    for a, b in cuts:
        edge = mixing.on_edges(words[a:b], tree)
        (h,), bit, _, n = mixing.word_hashes(words[a:b], scripts[a:b], tree, (0,))
        for key, pair in zip(*mixing.edge_counts(h[edge], bit[edge], np.repeat(counts[a:b], n)[edge])):
            met.setdefault(int(key), []).append(pair)
    shared = sorted(k for k, found in met.items() if len(found) > 1)
    edges = np.array(shared, np.uint64), np.array([sum(met[k]) for k in shared])
    none = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    whole = mixing.whole_slots(words, scripts, counts, tree, none)
    (h,), _, _, _ = mixing.word_hashes(words, scripts, tree, (0,))
    slots, n_hashes = np.unique(mixing._slot(np.unique(h), mixing.WHOLE), return_counts=True)
    for a, b in cuts:
        (h,), _, _, _ = mixing.word_hashes(words[a:b], scripts[a:b], tree, (0,))
        at = mixing._slot(h, mixing.WHOLE)
        at = at[~np.isin(at, slots[n_hashes > 1])] - mixing._OFFSETS[mixing.WHOLE]       # slots of one hash
        assert (mixing.whole_slots(words[a:b], scripts[a:b], counts[a:b], tree, edges)[at] == whole[at]).all()


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, n = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([3, 0, 4])
    good, moves = line_crf.marginals(emit, trans, n)
    at, expected, expected_moves = 0, [], np.zeros((2, 2))
    for k in n[n > 0]:
        e = emit[at:at + k]
        weight, hits, m = 0.0, np.zeros(k), np.zeros((2, 2))
        for code in range(2 ** k):
            y = [(code >> t) & 1 for t in range(k)]
            p = math.exp(sum(e[t] for t in range(k) if y[t]) + sum(trans[y[t], y[t + 1]] for t in range(k - 1)))
            weight += p
            hits += p * np.array(y)
            for t in range(k - 1):
                m[y[t], y[t + 1]] += p
        expected += (hits / weight).tolist()
        expected_moves += m / weight
        at += k
    assert np.allclose(good, expected) and np.allclose(moves, expected_moves)


def test_quality(spark, odd, odd_rows, none):
    rows = []
    for k in range(160):
        text = prose(k, 40 + k)
        rows.append((k, text if k % 4 else text.upper().replace(" ", "!! "), "a"))
    docs = frame(spark, rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(odd_rows)])
    labels = spark.createDataFrame([(k, int(bool(k % 4)), 0) for k in range(160)] + [(None, 1, 0), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = line_crf.train(docs, labels)
    scores = {r.doc_id: r.score for r in line_crf.score_quality(docs, model).collect()}
    held = [k for k in range(160) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((scores[k] >= 0.3) == bool(k % 4) for k in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 160 + len(odd_rows)
    assert line_crf.keep_good(docs, model).columns == docs.columns
    assert {r.score for r in line_crf.score_quality(odd, line_crf.train(docs, labels.limit(0))).collect()} == {0.5}
    assert line_crf.score_quality(none, model).count() == 0 and line_crf.train(none, labels) is None


def test_memory_of_a_slice():
    """What a task holds at once for line features, in a worker beside others."""
    text = prose(7, 3000).encode()
    texts = [text] * (line_crf.SLICE_BYTES // len(text))
    tracemalloc.start()
    line_crf.line_features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160 << 20


def test_words_of_many_texts_are_those_of_each():
    """Words are split and numbered for a slice at once; what they are stays that of ``bytes.split``."""
    texts = ["", "  ", "A b\x00 a\tÉ\x0bé\x0c c\x1c\x1d\x1e\x1fd\x85e\xa0f g", "\nA\r\n", "x" * 300, "b \u2003 İ ſ a"]
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    words, ids, n = words_of(column, mixing._LOWER)
    words = words.to_pylist()
    assert len(set(words)) == len(words)
    of = np.split(ids, np.cumsum(n)[:-1])
    assert [[words[i] for i in x] for x in of] == [t.encode().lower().split() for t in texts]
    assert len(words_of(pa.array([], pa.string()), mixing._LOWER)[0]) == 0


def test_words_are_counted_whatever_a_task_holds(spark, odd_rows, monkeypatch):
    """Numbers of training texts; words of other texts alone stand with 0."""
    expected = {}
    for i, text, _ in odd_rows:
        raw = (text or "").encode()
        script, other = int(mixing.scripts_of([raw])[0]), i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        for w in [*raw.lower().split(), b""]:
            expected[w, script] = expected.get((w, script), 0) + (not other)
    rows = frame(spark, odd_rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).coalesce(2)
    for flush in (mixing.FLUSH, 3):
        monkeypatch.setattr(mixing, "FLUSH", flush)
        assert {(bytes(r.word), r.script): r.c for r in mixing._counted(rows, 3).collect()} == expected


def test_slots_in_16_bits_keep_their_ratio():
    pair = np.array([[0, 0], [1, 65535], [65536, 1], [10**9, 3 * 10**9]], np.int64)
    expected = np.ceil(pair / np.maximum(pair.max(axis=1, keepdims=True) / 65535.0, 1.0)).astype(np.uint16)
    assert (mixing._scaled(pair) == expected).all() and (mixing._scaled(pair.astype(float)) == expected).all()
