import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from tessera.llm import resample

from .conftest import frame, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, longest):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(found), [" ".join(found[i:i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def brute_force(rows, target, longest, buckets, percent, min_words):
    def number(f):
        return crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for counts, texts in ((s, [text for _, text in rows]), (t, target)):
        for text in texts:
            counts.update(map(number, grams(text, longest)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        n, own = grams(text, longest)
        weight = sum(gain[number(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1:4]))
    drawn = Counter((*r, k) for k, r in enumerate(able[:percent * len(able) // 100], 1))
    return drawn + Counter((*r, None) for r in able[percent * len(able) // 100:]) + Counter((*r, None) for r in out if r[1] < min_words)


@pytest.mark.parametrize("longest, percent, listed", [(1, 10, 100_000), (3, 45, 2), (2, 100, 1)])
def test_draw_matches_brute_force(spark, odd_rows, monkeypatch, longest, percent, listed):
    monkeypatch.setattr(resample, "LIST", listed)
    rows = [(20 + i, prose(600 + i, 10 + i) + " É9 a_B-c\x00d İ") for i in range(60)] + [(7, prose(1, 60))] * 5 + [(i, t) for i, t, _ in odd_rows]
    target = [prose(1, 60), prose(605, 40), None, ""]
    table = frame(spark, [(i, t, "a") for i, t in rows])
    got = resample.resample(table, spark.createDataFrame([(t, 1) for t in target], "text string, n long"), longest=longest, buckets=97, percent=percent, min_words=20)
    got = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect())
    assert got == brute_force(rows, target, longest, 97, percent, 20)


def test_empty_tables_and_long_runs(spark, none, odd, odd_rows):
    assert resample.resample(none, odd).count() == 0
    assert resample.resample(odd, none).count() == len(odd_rows)
    assert [len(level) for level in resample.features([b"a", b"b"], 4)] == [2, 1, 0, 0]
    assert next(iter([level for level in resample.features([b"a", b"b"], 2)][1:]))[0] == crc32(b"a b")
