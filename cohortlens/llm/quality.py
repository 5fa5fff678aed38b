"""Quality rules from tokeniser fertility.

Public vocabularies say how well they know a text: characters per token, the
share of tokens that fall back to single bytes, and the entropy of the text's
tokens. Prose of one language lies in a narrow band of each; symbol soup,
tables of joined fragments, repeated words and wrong scripts do not.

Bands come from the corpus itself: per language (or script, where a row names
no language) and size class, the quartiles of every document that passes the
base rules, widened by BAND_WIDTH interquartile ranges. Both passes cover all
rows. A size class with fewer than BAND_DOCS documents joins the next lower
one, and the lowest the next higher one; so that a long text is not measured
by shorter ones, bands run along the measure's trend over 1 / log2(n_tokens):
the entropy of long texts stays, its share falls as that does. A language with fewer than BAND_DOCS documents takes the bands of all languages,
which are there as soon as one document passes the base rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.byte_bpe import read_ranks
from cohortlens.llm.common import give_back, held, saved, slices
from cohortlens.llm.words import shingles
from cohortlens.session import ship_package

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
BAND_WIDTH, BAND_DOCS = 2.5, 30
#: Bytes of text that are measured at a time; a word, its token ids and their counts take some 20 times as much.
MEASURED_BYTES = 1 << 20
#: The largest size class that a count of tokens can have.
MAX_CLASS = 62
#: Least half-width of a band, for classes of documents that are all alike.
LEAST_HALF = {"chars_per_token": 0.25, "chars_per_byte_token": 0.25, "byte_share": 0.05, "entropy_share": 0.05}
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: First code points of the scripts that rows without a language are told apart by.
SCRIPTS = ((0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "indic"),
           (0xE00, "thai"), (0xE80, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"),
           (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0x20000, "han"), (0x32000, "other"))
MEASURES = list(LEAST_HALF)
SCHEMA = ("__id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_tokens long, chars_per_token double, chars_per_byte_token double, byte_share double, entropy_share double")
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class _Vocabularies:
    """Tokens of single words under a SentencePiece model with byte fallback and a byte-level rank file; kept per worker, emptied when large."""

    limit = 200_000

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.byte_level = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        n = self.pieces.vocab_size()
        self.size = n
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(n)])
        self.empty()

    def empty(self):
        self.number = _Numbers()
        self.hashes = np.zeros(0, np.uint64)
        self.n_byte_level = np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.empty()
        out = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if new := self.number.new:
            self.number.new = []
            plain = [w.decode() for w in new]
            ids = self.pieces.encode(plain, num_threads=1)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.r_[self.start, len(self.tokens) + np.cumsum(length) - length]
            self.length = np.r_[self.length, length]
            self.tokens = np.r_[self.tokens, np.fromiter(chain.from_iterable(ids), np.int32, int(length.sum()))]
            self.hashes = np.r_[self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))]
            encode = self.byte_level.encode_ordinary
            self.n_byte_level = np.r_[self.n_byte_level, np.fromiter((len(encode(" " + w)) for w in plain), np.int64, len(plain))]
        return out


class _Numbers(dict):
    """Numbers words in the order of their first use; ``new`` holds those not yet looked at."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        n = self[word] = len(self)
        return n


def _repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside windows that occur at least twice; ``hashes`` are the windows'. Equal hashes are checked by the words."""
    s = np.sort(hashes)
    if not (s[1:] == s[:-1]).any():
        return 0
    w = REPEAT_WINDOW
    windows = [tuple(words[i:i + w]) for i in range(len(words) - w + 1)]
    often = Counter(windows)
    hit = np.fromiter((often[x] > 1 for x in windows), np.int64, len(windows))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:len(hit)] += hit
    edge[w:w + len(hit)] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _script(text: bytes) -> str:
    code = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    code = code[(code > 0x40) & ~((code > 0x5A) & (code < 0x61)) & ~((code > 0x7A) & (code < 0xC0))]
    if not len(code):
        return "none"
    at = np.searchsorted(np.array([s for s, _ in SCRIPTS]), code, side="right") - 1
    names = np.array([n for _, n in SCRIPTS])
    found, n = np.unique(names[at], return_counts=True)
    return str(found[n.argmax()])


def _measure(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held(("quality", key), lambda: _Vocabularies(*shared.value))
        for ids, texts in slices(batches, MEASURED_BYTES):
            split = [t.split() for t in texts]
            n_words = np.fromiter(map(len, split), np.int64, len(split))
            ends = np.cumsum(n_words)
            words = [w for s in split for w in s]
            number = vocabulary.numbers(words)
            windows = shingles(vocabulary.hashes[number], REPEAT_WINDOW)
            repeated = [_repeated_words(s, windows[end - n:end - REPEAT_WINDOW + 1]) if n >= REPEAT_WINDOW else 0
                        for s, n, end in zip(split, n_words.tolist(), ends.tolist(), strict=True)]
            chars = np.array([len(t.decode()) - sum(map(t.count, _singles(WHITE))) for t in texts], np.int64)
            symbols = np.array([sum(map(t.count, _singles(SYMBOLS))) for t in texts], np.int64)
            dup_lines = []
            for t in texts:
                lines = [x for x in t.split(b"\n") if x.split()]
                dup_lines.append(len(lines) - len(set(lines)))

            owner = np.repeat(np.arange(len(split)), n_words)
            length = vocabulary.length[number]
            n_tokens = np.bincount(owner, length, len(split)).astype(np.int64)
            n_byte_level = np.bincount(owner, vocabulary.n_byte_level[number], len(split))
            run_start = np.cumsum(length) - length
            token = vocabulary.tokens[np.arange(int(length.sum())) - np.repeat(run_start - vocabulary.start[number], length)]
            token_owner = np.repeat(np.arange(len(split)), n_tokens)
            n_bytes = np.bincount(token_owner[vocabulary.is_byte[token]], minlength=len(split))
            last = np.cumsum(n_tokens)
            for start, end in zip((last - n_tokens).tolist(), last.tolist(), strict=True):
                token[start:end].sort()
            heads = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (token_owner[1:] != token_owner[:-1])]) if len(token) else np.zeros(0, np.int64)
            count = np.diff(np.r_[heads, len(token)])
            whose = token_owner[heads]
            with np.errstate(divide="ignore", invalid="ignore"):
                entropy = np.log2(n_tokens) - np.bincount(whose, count * np.log2(count), len(split)) / n_tokens
                share = np.where(n_tokens > 1, entropy / np.log2(n_tokens), 1.0)
                columns = [ids, n_words, chars, symbols, dup_lines, repeated, n_tokens, chars / n_tokens, chars / n_byte_level, n_bytes / n_tokens, share]
            some = n_tokens > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(c, pa.float64(), mask=~some) for c in columns[7:]], names=_NAMES)
        give_back()     # the worker then waits beside the joins that follow, which need the executor's memory

    return run


def _singles(chars: bytes) -> list[bytes]:
    return [bytes([c]) for c in chars]


def measures(docs: DataFrame, model_path: str, ranks_path: str, pattern: str, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(__id, base counts, measures, band_key, size_class, shortness) of every row; the vocabularies are read by the driver (a few MB) and broadcast."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast((f.read(), read_ranks(ranks_path), pattern))
    text = docs.select(docs[id_col].cast("long").alias("__id"), F.coalesce(docs[text_col].cast("string").cast("binary"), F.lit(b"")).alias("__bytes"),
                       (docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")).alias("__lang"))
    rows = text.mapInArrow(_with_lang(_measure(f"{model_path}|{ranks_path}|{pattern}", shared)), SCHEMA + ", band_key string")
    log_size = F.log2(F.greatest("n_tokens", F.lit(1)))
    return rows.withColumn("size_class", F.floor(log_size).cast("int")).withColumn("shortness", 1 / F.greatest(log_size, F.lit(1.0)))


def _with_lang(run):
    """Carries the language past ``run``, which works on slices of the first two columns, as the key of the band; a row without one gets its script's."""
    def carried(batches):
        langs: list = []

        def two():
            for b in batches:
                langs.extend(f"script:{_script(b.column(1)[i].as_py())}" if lang is None else lang for i, lang in enumerate(b.column(2).to_pylist()))
                yield b

        for out in run(two()):
            n = out.num_rows
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(langs[:n], pa.string())], names=[*_NAMES, "band_key"])
            del langs[:n]

    return carried


def merged_classes(docs: dict[int, int]) -> dict[int, int]:
    """The group, named by its lowest size class, of every size class there can be, from the documents of each."""
    groups: list[list[int]] = []
    total = BAND_DOCS
    for c in sorted(docs, reverse=True):
        if total >= BAND_DOCS:
            groups.append([])
            total = 0
        groups[-1].append(c)
        total += docs[c]
    if len(groups) > 1 and total < BAND_DOCS:
        few = groups.pop()
        groups[-1] += few
    lowest = [g[-1] for g in groups]
    return {c: next((x for x in lowest if x <= c), lowest[-1]) for c in range(MAX_CLASS + 1)} if lowest else {}


def trend(points: list[tuple[int, float, float]]) -> float:
    """Slope of points (weight, x, y): the weighted median of the slopes between two of them, which a few points far off do not turn."""
    pairs = sorted(((y - v) / (x - u), n * m) for (n, x, y), (m, u, v) in combinations(points, 2) if x != u)
    half, total = sum(w for _, w in pairs) / 2, 0
    for slope, w in pairs:
        total += w
        if total >= half:
            return slope
    return 0.0


def _fitted(classes) -> tuple[tuple[float, ...], dict[int, int]]:
    """The measures' slopes over ``shortness``, and the groups, from the size classes' documents and medians (one row per class)."""
    classes = sorted(classes, key=lambda r: r["size_class"])
    return tuple(trend([(r["docs"], r["shortness"], r[m]) for r in classes]) for m in MEASURES), merged_classes({r["size_class"]: r["docs"] for r in classes})


def _bands(rows: DataFrame, key: Column, least: int) -> DataFrame:
    """(__key, size_class, band) of the keys with ``least`` documents: per measure its slope over ``shortness``, and the band of what the slope leaves."""
    rows = rows.withColumn("__key", key)
    medians = [F.percentile_approx(m, 0.5, 2000).alias(m) for m in ("shortness", *MEASURES)]
    sizes = rows.groupBy("__key", "size_class").agg(F.count("*").alias("docs"), *medians).groupBy("__key") \
        .agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("size_class", "docs", "shortness", *MEASURES)).alias("of")).where(F.col("docs") >= least)
    fit = F.udf(lambda of: _fitted(of), f"slope struct<{','.join(f'{m}:double' for m in MEASURES)}>, groups map<int,int>")
    fits = sizes.select("__key", fit("of").alias("fit"))
    placed = saved(fits.select("__key", F.col("fit.slope").alias("slope"), F.explode("fit.groups").alias("size_class", "group")))
    q = [F.percentile_approx(F.col(m) - F.col(f"slope.{m}") * F.col("shortness"), F.array(F.lit(0.25), F.lit(0.75)), 2000).alias(m) for m in MEASURES]
    found = rows.join(placed, ["__key", "size_class"]).groupBy("__key", "group").agg(*q)
    half = {m: F.greatest(F.lit(BAND_WIDTH) * (F.col(m)[1] - F.col(m)[0]), F.lit(LEAST_HALF[m])) for m in MEASURES}
    return saved(placed.join(found, ["__key", "group"]).select("__key", "size_class", F.struct(*[F.struct(
        F.col(f"slope.{m}").alias("slope"), (F.col(m)[0] - half[m]).alias("low"), (F.col(m)[1] + half[m]).alias("high")).alias(m) for m in MEASURES]).alias("band")))


def fertility_rules(docs: DataFrame, model_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: ``id_col``, the base counts, ``base_failed``, ``kept``, the measures and ``reasons`` (array<string>).

    Words are runs other than ASCII white space. ``base_failed``: fewer than
    20 words, or more than 30 % of the words in 8-word windows found twice or
    more. ``kept`` is false if the base rules fail or a measure lies outside
    its band: ``chars_per_token`` and ``byte_share`` under the SentencePiece
    model, ``chars_per_byte_token`` under the byte-level ranks,
    ``entropy_share`` (entropy over its largest value for that many tokens).
    A null, empty or blank text has no words, fails and has null measures. A
    null language (or ``lang_col=None``) takes the script's band. Null ids,
    ties and repeated rows stay as they are. An empty table gives no rows.
    """
    rows = saved(measures(docs, model_path, ranks_path, pattern, id_col, text_col, lang_col).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))))
    good = rows.where("not base_failed")
    by_key = _bands(good, F.col("band_key"), BAND_DOCS).select(F.col("__key").alias("band_key"), "size_class", F.col("band").alias("own"))
    by_size = _bands(good, F.lit("all"), 1).select("size_class", F.col("band").alias("general"))
    judged = rows.join(by_key, ["band_key", "size_class"], "left").join(by_size, "size_class", "left").withColumn("band", F.coalesce("own", "general"))
    rest = {m: F.col(m) - F.col(f"band.{m}.slope") * F.col("shortness") for m in MEASURES}
    outside = [F.when((rest[m] < F.col(f"band.{m}.low")) | (rest[m] > F.col(f"band.{m}.high")), F.lit(m)) for m in MEASURES]
    base = [F.when(F.col("n_words") < MIN_WORDS, F.lit("few_words")), F.when(100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"), F.lit("repeats"))]
    judged = judged.withColumn("reasons", F.array_compact(F.array(*base, *outside)))
    return judged.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (F.size("reasons") == 0).alias("kept"), "n_tokens", *MEASURES, "reasons")


def keep_good(docs: DataFrame, model_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", **columns) -> DataFrame:
    """Rows of ``docs`` that the rules keep, all columns. Rows are told apart by their id; rows that share one stay if one of them is kept, rows without an id go only if all such rows are rejected."""
    kept = fertility_rules(docs, model_path, ranks_path, pattern, id_col, **columns).where("kept") \
        .select(F.col(id_col).alias("__keep")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__keep")), "left_semi")
