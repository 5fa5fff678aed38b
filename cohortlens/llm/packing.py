"""Training sequences of a fixed length: concatenate all documents and cut.

Two passes give every token its place in one line of all tokens. The first
turns texts into ids, counts them, and keeps for each document where it starts
among the tokens of its partition; totals per partition are then summed over
the partitions before, which is a table of one row per partition. In the
second pass a document's place in the line is its start plus its partition's
offset, and a cut falls at every multiple of the length: a document yields one
record per window that it touches, so a document or a partition that crosses a
boundary has a record on both sides of it. Nothing is sorted or shuffled but
the totals, and padding is needed by the last sequence only.

Ids come from the distinct words of a slice of texts, with a memo per Python
worker, because a word's ids don't depend on its neighbours (see
``pack_documents``).
"""

from __future__ import annotations

import hashlib
import json
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import held, keyed_text, saved, slices

LENGTH = 2048
END_ID = 1
#: Words that a worker remembers, and their length in bytes; both bound its memory, not what is encoded.
MEMO_WORDS, MEMO_BYTES = 400_000, 64
#: Words in one call of the tokenizer.
JOINED = 500
#: Partitions whose totals are summed together before the groups' totals are.
GROUP = 1024


class _Encoder:
    """Ids of words as little-endian 32-bit integers.

    New words go through the tokenizer many at a time. What the tokenizer is seen to do anyway is done before: lower-casing
    A-Z, and splitting marks off a word's end, so fewer words are new. Words of letters only make
    one piece each, whose last id ends a word in vocabularies that mark that; for others, offsets say which word an id belongs to.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = t = Tokenizer.from_str(vocabulary)
        t.no_truncation()
        t.no_padding()
        self.memo: dict[bytes, bytes] = {}
        special = json.loads(vocabulary).get("added_tokens") or []
        self.special = [a["content"].encode() for a in special]
        self.specials = True    # whether the texts at hand may hold any
        self.lowers = t.normalizer is not None and t.normalizer.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        self.marks = "".join(c for c in string.punctuation if self._splits(c)).encode()
        end = json.loads(vocabulary)["model"].get("end_of_word_suffix")
        vocab = t.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends[i] = bool(end) and token.endswith(end)
        self.one_piece = bool(end) and self._pieces("abcé") == 1

    def _pieces(self, text: str) -> int:
        return len(self.tokenizer.pre_tokenizer.pre_tokenize_str(text)) if self.tokenizer.pre_tokenizer is not None else 1

    def _splits(self, c: str) -> bool:
        """Whether marks ``c`` behind a letter or digit are a piece of their own."""
        return all(self._pieces(x + c) == self._pieces(x + c * 3) == self._pieces(x + c + ".,") == self._pieces(x) + 1 for x in ("a", "1", "é"))

    def _by_offsets(self, text: list[str]) -> list[bytes]:
        start = np.cumsum(np.fromiter(map(len, text), np.int64, len(text)) + 1)
        found = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        end = 4 * np.searchsorted(np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids)), start)
        return [ids[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        text = b" ".join(words).decode("utf-8", "replace").split(" ") if words else []
        letters = [self.one_piece and t.isalpha() for t in text]
        for alone in (True, False):
            names, kind = ([x for x, y in zip(xs, letters, strict=True) if y is alone] for xs in (words, text))
            for i in range(0, len(kind), JOINED):
                some, known = kind[i:i + JOINED], names[i:i + JOINED]
                if alone:
                    ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
                    end = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                    if len(end) == len(some) and end[-1] == 4 * len(ids):
                        end, ids = end.tolist(), ids.tobytes()
                        out.update(zip(known, [ids[a:b] for a, b in zip([0, *end], end, strict=False)], strict=True))
                        continue
                out.update(zip(known, self._by_offsets(some), strict=True))
        return out

    def _cut(self, word: bytes, core: bytes) -> bool:
        """Whether the tokenizer splits ``word`` behind ``core``, of which it is the part before the last marks."""
        if not core or (self.specials and any(s in word for s in self.special)):
            return False
        last = core[-1:]
        return last.isalnum() or (last > b"\x7f" and core.decode("utf-8", "replace")[-1].lower().isalpha())

    def _learn(self, new: list[bytes]) -> None:
        memo, marks = self.memo, self.marks
        whole, cut = [], []
        for w in new:
            core = w.rstrip(marks)
            if core is w or not self._cut(w, core):
                whole.append(w)
            else:
                cut.append((w, core, w[len(core):]))
        parts = set(whole)
        for _, core, tail in cut:
            parts.add(core)
            parts.add(tail)
        memo.update(self._ids([p for p in parts if p not in memo]))
        for w, core, tail in cut:
            memo[w] = memo[core] + memo[tail]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text: its words are numbered, looked up once per slice, and written back in their order by Arrow."""
        if self.lowers:
            lower = [t.lower() for t in texts]
            texts = [t if any(s.lower() in x for s in self.special) else x for t, x in zip(texts, lower, strict=True)]
        self.specials = any(s in t for t in texts for s in self.special)
        raw = pa.array(texts, pa.large_binary())
        lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(raw), *raw.buffers()[1:]))    # bytes, whether or not they are UTF-8
        codes = lists.flatten().dictionary_encode()
        words = codes.dictionary.cast(pa.large_binary()).to_pylist()
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        self._learn([w for w in words if w and w not in memo])
        memo[b""] = b""
        ids = pa.array([memo[w] for w in words], pa.large_binary()).take(codes.indices)
        for w in [w for w in words if len(w) > MEMO_BYTES]:
            del memo[w]
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        at = at[lists.offsets.to_numpy()]
        flat = ids.buffers()[2].to_pybytes() if len(ids) and at[-1] else b""
        return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _tokenise(key: str, vocabulary, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("packing", key), lambda: _Encoder(vocabulary.value))
        part, at = TaskContext.get().partitionId(), 0
        for ids, texts in slices(batches):
            tokens = [t + end for t in encoder.of(texts)]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
            start = at + np.cumsum(size) - size
            at += int(size.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int64)), pa.array(ids, pa.int64()), pa.array(start), pa.array(size), pa.array(tokens, pa.binary())],
                names=["part", "id", "start", "n", "ids"])

    return run


def offsets(totals: DataFrame, group: int = GROUP) -> DataFrame:
    """(part, before): the sum of ``n`` over all smaller ``part`` in ``totals`` (part, n).

    Sums run inside groups of ``group`` consecutive partitions, then over one
    row per group, so no task holds more than a part in ``group`` of the table.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = totals.withColumn("g", F.floor(F.col("part") / group))
    over = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = t.groupBy("g").agg(F.sum("n").alias("n")).select("g", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    return t.withColumn("before", before).join(groups, "g").select("part", (F.col("before") + F.col("base")).alias("before"))


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's tokens are its ids under the tokenizers file, without added
    special tokens, and ``end_id``; ``start`` counts its tokens before the
    piece. Every sequence holds ``length`` tokens but the last, and the pieces
    of a sequence fill it from 0 without gaps. The order of documents is that
    of the input's partitions. The file's pre-tokenizer must drop or end at
    white space. A null or empty text has its end id only; bytes that are not
    UTF-8 count as U+FFFD; null ids, ties and repeated rows are packed as they
    are; an empty table gives no rows; other columns are not read. The
    offsets, one row per input partition, are broadcast: 16 bytes each,
    whatever the partitions hold.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    run = _tokenise(hashlib.sha256(vocabulary.encode()).hexdigest(), spark.sparkContext.broadcast(vocabulary), np.array([end_id], "<u4").tobytes())
    tokens = saved(keyed_text(docs, id_col, text_col).mapInArrow(run, "part long, id long, start long, n long, ids binary"))
    place = offsets(tokens.groupBy("part").agg(F.sum("n").alias("n")))
    line = tokens.join(F.broadcast(place), "part").withColumn("first", F.col("before") + F.col("start"))
    last = F.col("first") + F.col("n")

    def piece(sequence):
        begin = F.greatest(F.col("first"), sequence * length)
        size = F.least(last, (sequence + 1) * length) - begin
        start = begin - F.col("first")
        return F.struct(start.alias("start"), size.alias("length"), F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"),
                        sequence.alias("sequence_id"), (begin - sequence * length).alias("offset"))

    windows = F.sequence(F.floor(F.col("first") / length), F.floor((last - 1) / length))
    pieces = line.select(F.col("id").alias(id_col), F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return pieces.select(id_col, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """One row per sequence of ``pack_documents``: ``sequence_id``, ``n_tokens``, ``ids``, ``mask``.

    ``ids`` is padded with ``pad_id`` to ``length``, except where the number of
    tokens is a power of two; ``mask`` is 1 on tokens and 0 on padding. A
    sequence has at most ``length`` pieces, so its group is bounded.
    """
    def join(pdf):
        import pandas as pd
        ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), "<u4").astype(np.int64)
        n = len(ids)
        more = 0 if n & (n - 1) == 0 else length - n
        return pd.DataFrame({"sequence_id": pdf["sequence_id"].iloc[:1], "n_tokens": n, "ids": [np.r_[ids, np.full(more, pad_id)].astype(np.int64)],
                             "mask": [np.r_[np.ones(n), np.zeros(more)].astype(np.int8)]})

    return pieces.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInPandas(
        join, "sequence_id long, n_tokens long, ids array<long>, mask array<tinyint>")
