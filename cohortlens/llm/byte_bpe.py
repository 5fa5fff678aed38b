"""Byte-level BPE by longest matches and backtracking; exact, in linear time.

A token sequence is the one that merging by rank gives if and only if every
two neighbours are compatible, that is: merging the two tokens' bytes alone
gives back those two tokens. So the encoder walks the text with the longest
matching token, takes a shorter one where the neighbours are not compatible,
and steps back where none fits; a bit per position keeps it from trying a dead
end twice. Compatibility of two tokens is decided from their merge trees and
remembered.

pyahocorasick searches strings, so each byte stands as the Latin-1 character
of the same number.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import held, keyed_text, slices

#: Kept answers: pre-tokens and token pairs; each table is emptied when it has grown to this.
MEMO = 400_000
MEMO_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder of one vocabulary; ``ranks`` must hold all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        self.bytes_of = {i: t for t, i in by_rank}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing[:5]}")
        self.search = ahocorasick.Automaton()
        for t, i in by_rank:
            self.search.add_word(t.decode("latin-1"), (i, len(t)))
        self.search.make_automaton()
        self.sizes = {i: len(t) for t, i in by_rank}
        self.shorter = {i: self._longest_start(t) for t, i in by_rank}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.memo: dict[tuple[int, int], bool] = {}
        for t, i in by_rank:
            self.halves[i] = self._split(t, i)

    def _longest_start(self, token: bytes) -> int | None:
        """The longest other token that ``token`` starts with."""
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ranks.get(token[:n])) is not None:
                return i
        return None

    def _split(self, token: bytes, i: int) -> tuple[int, int]:
        """The last merge that makes ``token``; (i, i) for a byte or a token that merging never makes."""
        left = self.shorter[i]
        while left is not None:
            right = self.ranks.get(token[len(self.bytes_of[left]):])
            if right is not None and left < i and right < i and self._compatible(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens ``a`` and ``b`` alone: undo their merges, latest first, and look for an earlier merge across the border."""
        latest = 1 << 62
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < latest:
                return False
            (a1, a2), (b1, b2) = self.halves[a], self.halves[b]
            can_a, can_b = a2 != a or a1 != a, b1 != b or b2 != b
            if can_a and (a > b or not can_b):
                latest, a = a, a2
            elif can_b:
                latest, b = b + 1, b1
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self._compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (i, size) in self.search.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = i
        memo, sizes, shorter = self.memo, self.sizes, self.shorter
        alive = bytearray(b"\1") * (n + 1)
        token = longest[0]
        out, last, at = [], None, 0
        while at < n:
            while True:
                end = at + sizes[token]
                if alive[end]:
                    if last is None:
                        break
                    fits = memo.get((last, token))
                    if fits is None:
                        fits = self.fits(last, token)
                    if fits:
                        break
                token = shorter[token]
                if token is None:
                    if last is None:
                        raise ValueError("the vocabulary cannot make this text")
                    alive[at] = 0
                    token = out.pop()
                    at -= sizes[token]
                    last = out[-1] if out else None
            out.append(token)
            last, at = token, end
            if at < n:
                token = longest[at]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.encode_piece(m.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Joined(dict):
    """Pre-token to its ids as joined decimals; long pre-tokens are not kept."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.decimal = {i: str(i) for i in bpe.bytes_of}.__getitem__

    def __missing__(self, piece: str) -> str:
        ids = ",".join(map(self.decimal, self.bpe.encode_piece(piece.encode())))
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids


class _Spaced(dict):
    """A space and the text up to the next space, to ids as joined decimals.

    Where a space has no other white space beside it, a pattern that
    ``spaces_split`` is said of ends a pre-token before it, so these parts can
    be looked up whole.
    """

    uneven = re.compile(r"\s | \s")

    def __init__(self, joined: _Joined, spaces_split: bool):
        self.joined, self.find, self.split = joined, joined.bpe.pattern.findall, spaces_split

    def __missing__(self, part: str) -> str:
        ids = self.plain(" " + part)
        if len(part) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[part] = ids
        return ids

    def plain(self, text: str) -> str:
        return ",".join(map(self.joined.__getitem__, self.find(text)))

    def ids(self, text: str) -> str:
        if not self.split or self.uneven.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        spaced = ",".join(map(self.__getitem__, rest))
        return ",".join(x for x in (self.plain(first), spaced) if x)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True, spaces_split: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, ``n_tokens``, ``ids`` (array<int>, with ``keep_ids``), ``ids_sha256``, ``decoded_sha256``, ``round_trip``.

    Ids are those of merging by rank in each match of ``pattern``, special
    strings being plain text. ``spaces_split`` says that the pattern always
    ends a pre-token before a space that stands between two characters other
    than white space; repeated words are then looked up without matching.
    ``ids_sha256`` hashes the decimal ids joined by
    commas, ``decoded_sha256`` the bytes that the ids decode to,
    ``round_trip`` says that these equal the text. A null or empty text has no
    tokens. Repeated rows, ties and null ids stay as they are; other columns
    are not read. The driver reads the vocabulary (a few MB, whatever the
    input) and Spark broadcasts it.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, pattern))
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern, spaces_split)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaced = held(("byte_bpe", key), lambda: _Spaced(_Joined(ByteBpe(*shared.value)), spaces_split))
        bpe = spaced.joined.bpe
        bytes_of = {str(i): t for i, t in bpe.bytes_of.items()}.__getitem__
        for keys, texts in slices(batches):
            n_tokens, ids, hashes, decoded, equal = [], [], [], [], []
            for t in texts:
                s = spaced.ids(t.decode())
                each = s.split(",") if s else []
                back = b"".join(map(bytes_of, each))
                n_tokens.append(len(each))
                hashes.append(hashlib.sha256(s.encode()).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                equal.append(back == t)
                if keep_ids:
                    ids.append(list(map(int, each)))
            columns = [pa.array(keys, pa.int64()), pa.array(n_tokens, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []),
                       pa.array(hashes), pa.array(decoded), pa.array(equal, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"__id long, n_tokens long, {'ids array<int>, ' if keep_ids else ''}ids_sha256 string, decoded_sha256 string, round_trip boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    return keyed_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, ``text``) of rows of token ids. Null ids give a null text; bytes that are not UTF-8 give U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(frames):
        bytes_of = {i: t for t, i in shared.value.items()}
        for pdf in frames:
            pdf["text"] = [None if x is None else b"".join(map(bytes_of.__getitem__, map(int, x))).decode(errors="replace") for x in pdf["ids"]]
            yield pdf[["id", "text"]]

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInPandas(run, "id long, text string") \
        .withColumnRenamed("id", id_col)
