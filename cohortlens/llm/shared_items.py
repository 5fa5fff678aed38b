"""Which items of a corpus occur more than once, in three steps without a row per item.

An item is a 64-bit hash that a text yields (a shingle, an anchor of bytes).
A corpus has as many items as words, so a row per item would be many times
the input. Here each task packs the items of a block of texts into one byte
string per bucket of the hash; a bucket finds its repeated items by one sort;
what is repeated goes back to its block, packed again. Both shuffles deal out
by a hash (bucket, block), so no frequent item, text or source makes a hot
key: a third of all rows being one text still spreads over all buckets.

A block's number comes from the task's partition, so a task that runs again
after an executor was lost packs the same block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortlens.llm.common import give_back, held, slices, width

#: Texts and bytes of text in a block.
BLOCK_ROWS, BLOCK_BYTES = 50_000, 24 << 20
BUCKETS_PER_PARTITION = 4
_LOW32, _LOW48 = np.uint64(0xFFFFFFFF), np.uint64((1 << 48) - 1)


def planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, all lowest ones first: small numbers then compress to little."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def df_code(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 256 steps; the same count gives the same step everywhere."""
    return np.minimum(255, np.log2(counts) * 6).astype(np.uint8)


def shared_items(text: DataFrame, extract: Callable, meta_dtype, per_block: Callable, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows that ``per_block`` makes of each block's texts and of its items that occur at least twice in the corpus.

    ``text``: (__id, __bytes). ``extract(ids, texts)`` returns (meta, items,
    owner): a structured array with a row per text, the items' hashes (uint64)
    and, per item in rising order, a number below 2**32 that says where it
    stands, counted from 0 in this call. ``owner`` may be the text's index or
    a running position; ``extract`` returns its length as a fourth value.
    ``per_block(block, meta, where, items, code)`` makes a pandas frame of
    ``schema``; ``where`` counts through the block, ``items`` are hashes of 48
    bits and the bucket, ``code`` says how often an item occurs.
    """
    buckets = min(65_536, BUCKETS_PER_PARTITION * width(text.sparkSession))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("shared items", dict)      # lets go of the tables that another operator left in this worker
        part, chunk = TaskContext.get().partitionId(), 0
        parts: list = []
        rows = size = base = 0

        def flush():
            nonlocal parts, rows, size, base, chunk
            block = (part << 24) + chunk
            meta = np.concatenate([h[0] for h in parts])
            items = np.concatenate([h[1] for h in parts])
            where = np.concatenate([h[2] for h in parts])
            parts, rows, size, base = [], 0, 0, 0
            chunk += 1
            bucket = ((items >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            items, where = items[order], where[order]
            out: list[tuple] = [(-1 - block, block, meta.tobytes(), b"", b"")]
            start = 0
            for b, end in enumerate(ends):
                if end > start:
                    i, w = items[start:end], where[start:end]
                    out.append((b, block, planes((i & _LOW32).astype(np.uint32)), planes((i >> np.uint64(32)).astype(np.uint16)),
                                planes(np.diff(w, prepend=np.uint32(0)).astype(np.uint32))))
                start = end
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                names=["bucket", "block", "a", "b", "c"])

        for ids, texts in slices(batches):
            n_bytes = sum(map(len, texts))
            if rows and (rows + len(ids) > BLOCK_ROWS or size + n_bytes > block_bytes):
                yield flush()
            meta, items, where, span = extract(ids, texts)
            parts.append((meta, items, (where + np.uint64(base)).astype(np.uint32)))
            rows, size, base = rows + len(ids), size + n_bytes, base + span
        if parts:
            yield flush()
        give_back()

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["bucket"].iloc[0])
        if first < 0:
            return pd.DataFrame({"block": pdf["block"], "kind": 0, "bucket": first, "a": pdf["a"], "b": b"", "c": b"", "d": b""})
        pdf = pdf.sort_values("block", kind="stable")
        low = [from_planes(x, np.uint32) for x in pdf["a"]]
        high = [from_planes(x, np.uint16) for x in pdf["b"]]
        key = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
        order = np.argsort(key)
        s = key[order]
        heads = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        counts = np.diff(np.r_[heads, len(s)])
        per = np.zeros(len(s), np.uint8)
        per[order] = np.repeat(np.where(counts > 1, np.maximum(1, df_code(counts)), 0), counts)
        out, start = [], 0
        for block, lo, hi, c in zip(pdf["block"], low, high, pdf["c"], strict=True):
            code = per[start:start + len(lo)]
            start += len(lo)
            keep = np.flatnonzero(code)
            if len(keep):
                where = np.cumsum(from_planes(c, np.uint32), dtype=np.uint64).astype(np.uint32)[keep]
                out.append((block, 1, first, planes(lo[keep]), planes(hi[keep]), planes(np.diff(where, prepend=np.uint32(0)).astype(np.uint32)), code[keep].tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "a", "b", "c", "d"])

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = np.frombuffer(pdf.loc[pdf["kind"] == 0, "a"].iloc[0], meta_dtype)
        items, wheres, codes = [], [], []
        for r in pdf[pdf["kind"] == 1].itertuples(index=False):
            items.append(from_planes(r.a, np.uint32).astype(np.uint64) | (from_planes(r.b, np.uint16).astype(np.uint64) << np.uint64(32)) | np.uint64(r.bucket << 48))
            wheres.append(np.cumsum(from_planes(r.c, np.uint32), dtype=np.uint64).astype(np.uint32))
            codes.append(np.frombuffer(r.d, np.uint8))
        item = np.concatenate(items) if items else np.zeros(0, np.uint64)
        where = np.concatenate(wheres) if wheres else np.zeros(0, np.uint32)
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
        order = np.argsort(where, kind="stable")
        return per_block(int(pdf["block"].iloc[0]), meta, where[order], item[order], code[order])

    packed = text.mapInArrow(pack, "bucket long, block long, a binary, b binary, c binary")
    found = packed.groupBy("bucket").applyInPandas(repeated, "block long, kind int, bucket long, a binary, b binary, c binary, d binary")
    return found.groupBy("block").applyInPandas(blocks, schema)
