"""Byte-level BPE encoding and decoding (4).

A piece of text is encoded in linear time without a merge loop.  Every token
that occurs in the piece comes from one pass of an Aho-Corasick automaton
over the bytes mapped to Latin-1; the encoder takes the longest token at a
position and goes back to the next shorter one when it cannot stand after its
left neighbour.  Two neighbours can stand together if BPE on their joined
bytes gives just them; undoing merges from the later one back decides that,
and the answer is memoised.  For a vocabulary whose ids are merge ranks the
result is that of the merge loop.

Defined results: a null or empty text has no tokens and decodes to nothing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, slices, text_rows

MEMO = 3 << 18      # pieces remembered by a worker; a full memo starts anew
PAIR_MEMO = 1 << 20


# The pattern for which texts may be cut at single spaces (see encode).
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_GLUE = regex.compile(r"\x20(?:[\s\x1c-\x1f\x85]|$)").search
_EDGE = regex.compile(r"[\s\x1c-\x1f\x85]").match


def glued(words: list[str]) -> list[str]:
    """Parts of a text cut at single spaces, with a part that is empty or
    starts with white space put back to the one before it."""
    out: list[list[str]] = []
    for word in words:
        if out and (not word or _EDGE(word)):
            out[-1].append(word)
        else:
            out.append([word])
    return [" ".join(x) if len(x) > 1 else x[0] for x in out]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Memo(dict):
    """What a function gave for the last keys; a full memo starts anew."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value


class Merges:
    """What the encoder needs of a vocabulary; picklable."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.shorter = [self._prefix(t) for t in tokens]     # longest proper prefix that is a token
        self.split: list[tuple[int, int]] = []               # the last merge of each token; a byte gives itself
        self.joined: dict[tuple[int, int], int] = {}
        self.whole_only = set()                              # tokens which no merge reaches
        for i, token in enumerate(tokens):
            left = self.shorter[i]
            while left >= 0:
                right = self.rank.get(token[len(tokens[left]):], -1)
                if -1 < right < i and left < i and self.stand(left, right):
                    self.joined[left, right] = i
                    self.split.append((left, right))
                    break
                left = self.shorter[left]
            else:
                self.split.append((i, i))
                if len(token) > 1:
                    self.whole_only.add(i)

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (found := self.rank.get(token[:n])) is not None:
                return found
        return -1

    def stand(self, a: int, b: int) -> bool:
        """True if BPE leaves token ``a`` next to token ``b``.  Undo the
        later of the two last merges; a pair across the seam that would have
        merged before it rules the neighbours out."""
        joined, split = self.joined, self.split
        limit = len(self.tokens)
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True


class Encoder:
    """Per-process encoder over broadcast ``Merges`` with bounded memos."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pieces = merges, regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(merges.tokens):
            if i not in merges.whole_only:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size = [len(t) for t in merges.tokens]
        self.memo = Memo(lambda piece: self.piece(piece.encode()))
        self.spaced = Memo(lambda cut: self.chunk(" " + cut))
        self.cuts = pattern == CUT_PATTERN
        self.pairs: dict[int, bool] = {}

    def piece(self, raw: bytes) -> tuple[int, ...]:
        merges = self.merges
        if (whole := merges.rank.get(raw)) is not None:
            return (whole,)
        size, n = self.size, len(raw)
        longest = [-1] * n
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - size[token]] = token          # later ends are longer
        pairs, shorter, open_ = self.pairs, merges.shorter, [True] * (n + 1)
        if len(pairs) > PAIR_MEMO:
            pairs.clear()
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            end = at + size[token]
            if open_[end] and token not in merges.whole_only:
                if out:
                    key = out[-1] << 32 | token
                    if (fits := pairs.get(key)) is None:
                        fits = pairs[key] = merges.stand(out[-1], token)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:                                           # nothing fits here: give back the last token
                open_[at] = False
                token = out.pop()
                at -= size[token]
        return tuple(out)

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of text, piece by piece."""
        return tuple(chain.from_iterable(map(self.memo.__getitem__, self.pieces(text))))

    def encode(self, text: str) -> list[int]:
        """A space before a character that is not white space always starts
        a piece under the patterns of this kind, so the text is cut there and
        each cut is looked up whole."""
        if not self.cuts:
            return list(self.chunk(text))
        words = text.split(" ")
        if _GLUE(text):
            words = glued(words)
        out = list(self.chunk(words[0]))
        out.extend(chain.from_iterable(map(self.spaced.__getitem__, words[1:])))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.tokens.__getitem__, ids))


_LOCAL: dict[str, Encoder] = {}


def encoder(shared, pattern: str) -> Encoder:
    """The worker's own encoder of a broadcast vocabulary."""
    key = f"{shared.value.tokens[-1]!r} {len(shared.value.tokens)} {pattern}"
    if key not in _LOCAL:
        _LOCAL.clear()
        _LOCAL[key] = Encoder(shared.value, pattern)
    return _LOCAL[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every document, in one pass; the
    vocabulary is broadcast (its file bounds the size)."""
    rows = text_rows(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Merges(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared, pattern)
        for part in slices(batches):
            ids = [enc.encode(t) for t in part.column("text").to_pylist()]
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(flat, np.array([len(x) for x in ids]))],
                                             ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes binary) back from token ids; a null array decodes to
    nothing."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.__getitem__
        for part in batches:
            out = [b"".join(map(token, x or ())) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encode every text, decode its ids and return digests of both:
    doc_id, n_tokens, n_bytes, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded bytes), exact (they are the
    text's bytes).  One pass, nothing wider than a digest leaves a task."""
    rows = text_rows(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Merges(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared, pattern)
        number = [str(i) for i in range(len(enc.size))].__getitem__
        for part in slices(batches):
            out = []
            for text in part.column("text").to_pylist():
                ids = enc.encode(text)
                raw = enc.decode(ids)
                out.append((len(ids), len(raw), hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest(),
                            hashlib.sha256(raw).hexdigest(), raw == text.encode()))
            n, size, a, b, same = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array(a), pa.array(b), pa.array(same)],
                ["doc_id", "n_tokens", "n_bytes", "ids_sha256", "decoded_sha256", "exact"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_bytes long, "
                                "ids_sha256 string, decoded_sha256 string, exact boolean")
