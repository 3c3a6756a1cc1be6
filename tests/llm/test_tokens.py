import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_files

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
MERGES = bpe.Merges(bpe.read_ranks(RANKS))
OURS = bpe.Encoder(MERGES, P.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=MERGES.rank, special_tokens={})
LIBRARY = Tokenizer.from_file(WORDS)
CUTS = token_files.WordIds(open(WORDS, encoding="utf-8").read())
BITS = ["Ab", "B", " ", "  ", "\n", "\t", " ", ".", ",", "1", "'s", "'", "é", "É", "é", "Σ", "ΑΣ", "<|endoftext|>", "İ",
        " ", "ß", "漢", "!!", "%", "<|", "\x1c", "\x85", "\r", "ſ", "`"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(BITS), max_size=14).map("".join)))
def test_both_encoders_give_the_libraries_ids(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)
    assert OURS.decode(OURS.encode(text)) == text.encode()
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CUTS.encode(text) == expected
    ids, ends = CUTS.encode_all(pa.array([text, "", text + " ", "ab. " + text]))
    parts = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert parts[:2] == [expected, []]
    assert parts[2:] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in (text + " ", "ab. " + text)]


def test_pieces_made_of_tokens():
    rng = random.Random(5)
    for _ in range(3000):
        text = b"".join(rng.choice(MERGES.tokens) for _ in range(rng.randint(1, 8))).decode("utf-8", "ignore")
        assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 60000, "ab" * 20000, "!" * 30000, " " * 30000])
def test_long_runs_take_linear_time(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_round_trip(spark, odd, odd_rows, none):
    got = sorted(map(tuple, bpe.round_trip(odd, RANKS, P.PATTERN).collect()), key=str)
    expected = []
    for i, text, _ in odd_rows:
        ids = THEIRS.encode_ordinary(text or "")
        raw = (text or "").encode()
        expected.append((i, len(ids), len(raw), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest(), True))
    assert got == sorted(expected, key=str)
    back = bpe.decode_documents(bpe.encode_documents(odd, RANKS, P.PATTERN), RANKS).collect()
    assert sorted((r.doc_id or 0, bytes(r.bytes)) for r in back) == sorted((i or 0, (t or "").encode()) for i, t, _ in odd_rows)
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 20), max_size=300))
def test_elias_fano(gaps):
    values = np.cumsum(np.array(gaps, dtype=np.int64))
    raw = token_files.EliasFano.of(values).to_bytes()
    back, end = token_files.EliasFano.from_bytes(memoryview(raw), 0)
    assert end == len(raw) and back.values().astype(np.int64).tolist() == values.tolist()
    if len(values):
        assert len(raw) < 40 + len(values) * (2 + max(1, int(values[-1]) // len(values)).bit_length()) / 8 + 8


def test_token_files(spark, odd, odd_rows, none):
    path = token_files.write_token_files(odd, WORDS, end_id=2, shard_ids=500)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _, _ in odd_rows), key=lambda i: (i is not None, i))
    at, ids = 0, {}
    for i, text, _ in odd_rows:
        ids.setdefault(i, []).append(np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    for r in got:
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in ids[r.doc_id]]
    shard = token_files.Shard(bytes(spark.read.parquet(path).first().payload))
    assert shard.tokens(0).tolist()[-1] == 2
    assert token_files.read_token_files(spark, token_files.write_token_files(none, WORDS, end_id=2)).count() == 0
