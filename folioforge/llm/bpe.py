"""Byte-level BPE in linear time: longest matches from an Aho-Corasick automaton, backtracking over memoised pair checks.

Every match of the split pattern is encoded by itself. Bytes are mapped to Latin-1 characters, so that the automaton,
which works on text, sees one character a byte. A sequence of tokens is what merging by rank would give exactly if each
two adjacent tokens are what merging would give for their joined bytes; so the encoder takes the longest token at each
place, falls back to shorter ones while the pair with the token before is not compatible, and marks ends from which no
sequence goes on, so that none is tried twice. The automaton gives the longest tokens of a whole run of places at once,
each where the one before ends; it is asked again only where a shorter token has led to a place outside these runs.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, spread, text_of
from .kernel import blocks, tidied

#: Encoded pieces kept per worker at most; beyond it those go that were longest not asked for.
MEMO_PIECES = 200_000
#: Pairs of adjacent tokens whose compatibility a worker keeps at most; beyond it the memo starts anew.
MEMO_PAIRS = 400_000
#: Bytes of text or ids taken at once.
BLOCK = 1 << 20


class PieceMemo(dict):
    """Packed ids of pieces: the half that was asked for last, with the half before it aside, from which pieces come back."""

    def __init__(self, made: Callable[[str], bytes]):
        self.made = made
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.pop(piece, None)
        if packed is None:
            packed = self.made(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO_PIECES // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class BytePairCodec:
    """ranks: token bytes to id, where a smaller id merges first. All single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.no_limit = max(self.bytes_of) + 1
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(b) for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.memo = PieceMemo(self._packed_piece)
        self._tokens: pa.Array | None = None

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a token that no merge makes."""
        if token not in self.halves:
            whole = self.bytes_of[token]
            found = None
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if left is not None and right is not None and left < token and right < token and self._joins(left, right, token):
                    found = (left, right)
                    break
            self.halves[token] = found
        return self.halves[token]

    def _joins(self, left: int, right: int, limit: int) -> bool:
        """Whether merging leaves a border between the two tokens until only ids from limit on could cross it."""
        while True:
            crossing = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if crossing is not None and crossing < limit:
                return False
            # Undo the later of the two merges: what it made was not there yet when the earlier one happened.
            a, b = self._halves(left), self._halves(right)
            if a is not None and (b is None or left > right):
                limit, left = min(limit, left), a[1]
            elif b is not None:
                # A crossing merge of equal rank would start further left and so come first.
                limit, right = min(limit, right + 1), b[0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        key = left * self.no_limit + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._joins(left, right, self.no_limit)
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if none."""
        if token not in self.shorter:
            whole = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ranks), -1)
        return self.shorter[token]

    def _longest(self, text: str, at: int, longest: list[int]) -> int:
        """The longest token at a place. Those at the places where one after the other ends are noted, up to a noted one."""
        place = at
        for end, token in self.automaton.iter_long(text, at):
            if longest[place] != -1:
                break
            longest[place] = token
            place = end + 1
        return longest[at]

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        text, size = piece.decode("latin-1"), len(piece)
        length, shorter, fits, limit = self.length, self.shorter.get, self.fits.get, self.no_limit
        longest = [-1] * size
        out: list[int] = []
        dead = bytearray(size + 1)
        at, last, token = 0, -1, self._longest(text, 0, longest) if size else -1
        while at < size:
            while token != -1:
                end = at + length[token]
                if not dead[end]:
                    known = True if last == -1 else fits(last * limit + token)
                    if self.compatible(last, token) if known is None else known:
                        break
                known = shorter(token)
                token = self._next_shorter(token) if known is None else known
            if token != -1:
                out.append(token)
                at, last = end, token
                if at < size:
                    token = longest[at]
                    if token == -1:
                        token = self._longest(text, at, longest)
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self._next_shorter(token)
        return out

    def _packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode_all(self, packed: pa.Array) -> pa.Array:
        """The bytes of each row's ids, from one look-up of the whole array in a table of all tokens. Null gives null."""
        if self._tokens is None:
            self._tokens = pa.array([self.bytes_of.get(i) for i in range(self.no_limit)], pa.binary())
        parts = packed.drop_null()
        _, offsets, data = parts.buffers()
        ends = np.frombuffer(offsets, np.int32)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
        if ((ends - ends[0]) % 4).any():
            raise ValueError("ids are not whole 32-bit integers")
        ids = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u4") if ends[-1] > ends[0] else np.zeros(0, np.uint32)
        found = self._tokens.take(pa.array(ids, pa.uint32()))
        if found.null_count:
            raise ValueError("ids that no token has")
        _, starts, joined = found.buffers()
        starts = np.frombuffer(starts, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(starts[(ends - ends[0]) // 4].astype(np.int32)), joined or pa.py_buffer(b"")])
        if len(parts) == len(packed):
            return whole
        valid = packed.is_valid().to_numpy(zero_copy_only=False)
        return whole.take(pa.array(np.cumsum(valid) - 1, mask=~valid))

    def decode(self, packed: bytes) -> bytes:
        return self.decode_all(pa.array([packed], pa.binary()))[0].as_py()


@cache
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec.from_file(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): ids of each whole text as little-endian unsigned 32-bit integers in a binary column.

    path names the rank file, which every executor must have. Null and empty texts give no ids. Repeated rows give
    repeated results, an empty table none; other columns of docs are not read.
    """
    schema = docs.select(F.col(key), F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in (s for b in batches for s in blocks(b, 1, BLOCK)):
            ids = [coder.encode(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=[key, "ids"])

    return docs.select(F.col(key), text_of(text).alias("__text")).mapInArrow(tidied(run), schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the bytes of each row's ids. Null ids give null."""
    schema = encoded.select(F.col(key), "ids", F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in (s for b in batches for s in blocks(b, 1, BLOCK)):
            yield pa.record_batch([batch.column(0), batch.column(1), coder.decode_all(batch.column(1))], names=[key, "ids", "decoded"])

    return encoded.select(F.col(key), "ids").mapInArrow(tidied(run), schema)


def reference_ids(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Plain merging by rank, for tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def digest(packed: bytes) -> str:
    return hashlib.sha256(packed).hexdigest()


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = decode_documents(encode_documents(spread(documents(spark, sf_dir)), path), path)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
