"""Token counts without token ids.

A pre-token here is a run of bytes between ASCII white space: tokenizers that
drop white space (or whose pre-tokenizer ends at it) give a text as many
tokens as its pre-tokens have together. So the tokenizer sees each distinct
pre-token of the corpus once, in the bucket that its hash names; a block of
documents holds their (pre-token, frequency) pairs and gets the counts of its
distinct pre-tokens back; each document's count is a sum of products. No ids
are made for documents.

A pre-token stands once per block in the shuffles, however frequent it is, and
both shuffles deal out by a hash (bucket, block), so none makes a hot key. A
block's number comes from the task's partition, so a task that runs again
after an executor was lost packs the same block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm.common import held, keyed_text, slices, width
from cohortlens.llm.shared_items import BUCKETS_PER_PARTITION, from_planes, planes

BLOCK_ROWS, BLOCK_BYTES = 20_000, 16 << 20
OVER = 2048
_META = np.dtype([("id", "i8"), ("null", "u1"), ("n_bytes", "i8"), ("distinct", "i8")])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _pack(buckets: int):
    """Per block: a row for its documents with their (number, frequency) pairs, and a row per bucket of its distinct pre-tokens; numbers follow the buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        numbers, meta, which, often = _Numbers(), [], [], []
        rows = size = 0

        def block():
            at = (part << 24) + chunk
            pieces = list(numbers)
            bucket = np.fromiter((xxhash.xxh32_intdigest(p) % buckets for p in pieces), np.uint16, len(pieces))
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            pairs = []
            for w, c in zip(which, often, strict=True):
                w = rank[w]
                by = np.argsort(w)
                pairs.append((np.diff(w[by], prepend=np.uint32(0)).astype(np.uint32), c[by].astype(np.uint32)))
            out = [(-1 - at, at, np.array(meta, _META).tobytes(), *(planes(np.concatenate(x)) for x in zip(*pairs, strict=True)))]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            start = 0
            for k, end in enumerate(ends.tolist()):
                if end > start:
                    out.append((k, at, b" ".join(map(pieces.__getitem__, order[start:end].tolist())), b"", b""))
                start = end
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "a", "b", "c"])

        for keys, texts in slices(batches):
            n_bytes = sum(map(len, texts))
            if rows and (rows + len(keys) > BLOCK_ROWS or size + n_bytes > BLOCK_BYTES):
                yield block()
                numbers, meta, which, often = _Numbers(), [], [], []
                rows, size, chunk = 0, 0, chunk + 1
            for key, t in zip(keys, texts, strict=True):
                words = t.split()
                w, c = np.unique(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)), return_counts=True)
                meta.append((key or 0, key is None, len(t), len(w)))
                which.append(w)
                often.append(c)
            rows, size = rows + len(keys), size + n_bytes
        if rows:
            yield block()

    return run


def _tokenizer(vocabulary: str) -> Tokenizer:
    t = Tokenizer.from_str(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


def _counter(key: str, shared):
    """Tokens of each distinct pre-token of a bucket, handed to every block that has it."""
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        if bucket < 0:
            return pdf[["block", "bucket", "a", "b", "c"]]
        pieces = [bytes(x).split(b" ") for x in pdf["a"]]
        distinct = list(dict.fromkeys(p for x in pieces for p in x))
        tokenizer = held(("tokenizer", key), lambda: _tokenizer(shared.value))
        n: dict[bytes, int] = {}
        for i in range(0, len(distinct), 2000):
            some = distinct[i:i + 2000]
            n.update(zip(some, (len(e.ids) for e in tokenizer.encode_batch([p.decode() for p in some], add_special_tokens=False)), strict=True))
        counts = [planes(np.fromiter(map(n.__getitem__, x), np.uint32, len(x))) for x in pieces]
        return pd.DataFrame({"block": pdf["block"], "bucket": bucket, "a": counts, "b": b"", "c": b""})

    return count


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of count times frequency over the documents of a block."""
    pdf = pdf.sort_values("bucket")
    docs = pdf.iloc[0]
    meta = np.frombuffer(docs["a"], _META)
    n = np.concatenate([np.zeros(0, np.uint32), *(from_planes(x, np.uint32) for x in pdf["a"].iloc[1:])]).astype(np.int64)
    which, often = from_planes(docs["b"], np.uint32).astype(np.int64), from_planes(docs["c"], np.uint32).astype(np.int64)
    ends = np.cumsum(meta["distinct"])
    starts = ends - meta["distinct"]
    total = np.r_[0, np.cumsum(which)]
    run = np.r_[0, np.cumsum(n[total[1:] - np.repeat(total[starts], meta["distinct"])] * often)]
    return pd.DataFrame({"id": pd.Series(meta["id"]).astype("Int64").mask(pd.Series(meta["null"] == 1)), "n_bytes": meta["n_bytes"], "n_tokens": run[ends] - run[starts]})


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", over: int = OVER) -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > ``over``).

    ``tokenizer_path`` names a file of the tokenizers library whose
    pre-tokenizer drops or ends at white space; counts are the library's own
    per pre-token, without added special tokens, special strings in texts
    handled as its default. A null or empty text has 0 tokens; null ids, ties
    and repeated rows stay as they are; an empty table gives no rows; other
    columns are not read. The driver reads the vocabulary (a few MB, whatever
    the input) and Spark broadcasts it.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    shared, key = spark.sparkContext.broadcast(vocabulary), hashlib.sha256(vocabulary.encode()).hexdigest()
    buckets = min(65_536, BUCKETS_PER_PARTITION * width(spark))
    packed = keyed_text(docs, id_col, text_col).mapInArrow(_pack(buckets), "bucket long, block long, a binary, b binary, c binary")
    counted = packed.groupBy("bucket").applyInPandas(_counter(key, shared), "block long, bucket long, a binary, b binary, c binary")
    return counted.groupBy("block").applyInPandas(_sums, "id long, n_bytes long, n_tokens long") \
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
