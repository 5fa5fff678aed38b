"""Each operator against a brute-force version on one table that holds the odd cases too."""

import hashlib
import random

import brute
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortlens.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality, secret_scan, substring_dedup, suffix_dedup, token_counts, url_rules
from cohortlens.llm.queries import vocabularies

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_substring_dedup(documents, rows, distinct):
    got = substring_dedup.repeated_passages(documents).collect()
    assert len(got) == len(rows)
    out = {r["doc_id"]: r for r in got}
    exact = brute.repeated_windows(distinct)
    missed = total = 0
    for i, places in exact.items():
        flagged = {p for s in out[i]["spans"] for p in range(s["start"], s["end"])}
        total += len(places)
        missed += len(places - flagged)
        assert out[i]["n_words"] == len(brute.words(dict(distinct)[i]))
        assert out[i]["n_repeated"] == len(flagged) and out[i]["n_dropped"] <= out[i]["n_repeated"]
    assert total > 2000 and missed <= 0.01 * total
    # a changed word, and a passage inside other words
    assert {10_007} == set(out[10_008]["class_ids"]) == set(out[10_013]["class_ids"])
    assert out[10_013]["n_dropped"] >= 110 and out[10_007]["n_dropped"] == 0
    for i in (10_001, 10_002, 10_003, 10_004, 10_006):
        assert out[i]["spans"] == []


def test_substring_dedup_empty(documents):
    assert substring_dedup.repeated_passages(documents.limit(0)).count() == 0


def test_substring_dedup_finds_what_no_hub_explains(spark):
    """Passages of one template, each with its own choice of words at four places: a hub is no near duplicate of most of them."""
    rng = random.Random(3)
    rows = []
    for i in range(400):
        w = [f"t{k}" for k in range(60)]
        for at in (8, 22, 36, 50):
            w[at] = f"c{at}x{rng.randrange(5)}"
        rows.append((i, " ".join([f"own{i}a{k}" for k in range(20)] + w + [f"own{i}b{k}" for k in range(20)])))
    got = {r["doc_id"]: {p for s in r["spans"] for p in range(s["start"], s["end"])} for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: [brute.shingle_set(" ".join(t.split()[k:k + 50])) for k in range(20, 31)] for i, t in rows}
    by_window = [{} for _ in range(11)]
    for i, s in sets.items():
        for k in range(11):
            by_window[k].setdefault(s[k], []).append(i)
    for k, kinds in enumerate(by_window):
        for a, ids in kinds.items():
            if len(ids) > 1 or any(b is not a and 100 * len(a & b) >= 80 * len(a | b) for b in kinds):
                for i in ids:
                    assert set(range(20 + k, 70 + k)) <= got[i], (i, k)


def test_substring_dedup_of_a_text_that_repeats_itself(spark):
    once, part = [f"o{k}" for k in range(90)], [f"p{k}" for k in range(70)]
    near = ["changed" if k == 35 else w for k, w in enumerate(part)]
    rows = [(1, " ".join(part + part)), (2, " ".join(once + [f"q{k}" for k in range(60)] * 3)), (3, " ".join(f"s{k}" for k in range(140))), (4, " ".join([f"r{k}" for k in range(40)] * 2))]
    rows += [(5, " ".join([f"{w}x" for w in part] + [f"{w}x" for w in near])), (6, "a b " * 3000)]
    out = {r["doc_id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["n_repeated"] for i in range(1, 7)] == [140, 185, 0, 0, 140, 6000]     # five words before a passage make a near duplicate still
    assert all(r["n_dropped"] == 0 and r["class_ids"] == ([r["doc_id"]] if r["n_repeated"] else []) for r in out.values())


@pytest.mark.parametrize("seed", range(5))
def test_what_is_asked_for_is_in_every_near_duplicate(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    a = rng.permutation(np.arange(1, 120, dtype=np.uint64))
    b = np.insert(np.delete(a, rng.choice(119, 4, False)), rng.choice(115, 4), np.arange(500, 504, dtype=np.uint64))
    often = {int(t): int(rng.integers(1, 200)) for t in {*a.tolist(), *b.tolist()}}
    codes = lambda x: np.array([often[int(t)] for t in x], np.uint8)
    tokens, kind = substring_dedup.asked_tokens(b, codes(b), np.zeros(len(b), bool), 46, 80)
    reply = set(tokens.tolist())
    met = 0
    for k in range(len(a) - 45):
        w = a[k:k + 46]
        if substring_dedup.near_duplicate_places(w, b, 46, 80)[0].any():
            asks, kind = substring_dedup.asked_tokens(w, codes(w), np.zeros(46, bool), 46, 80)
            assert (kind == 2).sum() == 6 and reply & set(asks[kind == 2].tolist())
            met += 1
    assert met > 10 and substring_dedup.answers(46, 80) == 12


@pytest.mark.parametrize("seed", range(5))
def test_compact_windows_hold_every_subsequence_once(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 6, 40).astype(np.uint64)
    windows = substring_dedup.compact_windows(h, 7)
    for i in range(40):
        for j in range(i + 6, 40):
            of = [(a, c, b) for a, c, b in windows.tolist() if a <= i <= c <= j <= b]
            assert len(of) == 1 and h[of[0][1]] == h[i:j + 1].min()


@pytest.mark.parametrize("seed", range(20))
def test_compact_starts_are_what_compact_windows_hold(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    h = rng.integers(0, 3 + 20 * seed, 200).astype(np.uint64)
    held = np.full(200 - 45, 99, np.uint64)
    for left, c, right in substring_dedup.compact_windows(h, 46).tolist():
        held[max(left, c - 45):min(c, right - 45) + 1] = h[c]
    least, many = substring_dedup.compact_starts(h, 46)
    assert (np.repeat(least, many) == held).all()


def test_verified_spans_of_a_hub_come_once():
    """A hub that many regions meet has one row of spans, not one per region."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    hub = rng.integers(0, 1 << 62, 2000).astype(np.uint64)
    parts = [hub[i:i + 300] for i in range(0, 1700, 10)]
    pairs = pd.DataFrame({"rid": range(len(parts)), "hub": -1, "seq": [x.tobytes() for x in parts], "hub_seq": hub.tobytes()})
    out = pd.concat(list(substring_dedup._verify(46, 80, 8, 4)(iter([pairs[:90], pairs[90:]]))))
    assert sorted(out.loc[out["a"] != out["b"], "a"]) == list(range(len(parts)))
    spans = [s for row in out["in_b"] for s in row]
    assert spans == [{"start": 0, "end": 1990}]


def test_near_duplicate_places_of_frequent_tokens():
    """A passage that stands three times in a text of one token over and over is found at all three places."""
    import numpy as np
    passage = np.arange(100, 200, dtype=np.uint64)
    over, between = np.full(2000, 7, np.uint64), np.arange(1000, 4000, dtype=np.uint64)
    a = np.concatenate([over, np.arange(5000, 5100, dtype=np.uint64), passage])
    b = np.concatenate([over, between, passage, between[:500] + np.uint64(9000), passage, between[500:] + np.uint64(9000), passage])
    in_a, in_b = substring_dedup.near_duplicate_places(a, b, 46, 80)
    assert in_a[-100:].all() and in_a[:2000].all() and in_b[:2000].all()
    for start in (5000, 5600, 8200):
        assert (b[start:start + 100] == passage).all() and in_b[start:start + 100].all()
    assert not in_b[2030:4970].any()


@pytest.mark.parametrize("seed", range(20))
def test_unlisted_matches_make_the_same_bands(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 3 + 15 * seed, rng.integers(50, 300)).astype(np.uint64) for _ in range(2))
    b[20:45] = a[5:30]
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    args = a, np.flatnonzero(high > low), low, high, order, seed
    one, other = (list(f(*args)) for f in (substring_dedup._listed_bands, substring_dedup._unlisted_bands))
    assert len(one) == len(other) and all((x == y).all() for x, y in zip(one, other, strict=True))


def test_quality(documents, rows):
    got = quality.fertility_rules(documents, *vocabularies()).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        base = brute.quality_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r["kept"] and r["base_failed"])
        assert r["kept"] == (r["reasons"] == [])
    # measures of one text, from the libraries
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=vocabularies()[0])
    one = next(r for r in got if r["n_words"] > 50 and r["doc_id"] in texts and r["doc_id"] < 100)
    ids = [i for w in texts[one["doc_id"]].split() for i in model.encode(w)]
    assert one["n_tokens"] == len(ids)
    assert one["chars_per_token"] == pytest.approx(one["word_chars"] / len(ids))
    assert one["byte_share"] == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
    assert quality.fertility_rules(documents.limit(0), *vocabularies()).count() == 0
    kept = quality.keep_good(documents, *vocabularies())
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in got if r["kept"]}


def test_quality_measures_little_text_at_a_time_and_gives_memory_back(monkeypatch):
    import pyarrow as pa
    seen, back = [], []

    class Shared:
        value = (open(vocabularies()[0], "rb").read(), byte_bpe.read_ranks(vocabularies()[1]), vocabularies()[2])

    numbers = quality._Vocabularies.numbers
    monkeypatch.setattr(quality._Vocabularies, "numbers", lambda self, words: seen.append(sum(map(len, words))) or numbers(self, words))
    monkeypatch.setattr(quality, "give_back", lambda: back.append(1), raising=False)
    texts = [f"{i} plain words ".encode() * 10_000 for i in range(40)]
    out = list(quality._measure("a test", Shared)(iter([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], names=["__id", "__bytes"])])))
    assert sum(b.num_rows for b in out) == 40 and max(seen) <= 1 << 20 and back == [1]


def test_quality_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.01"
    out = quality.fertility_rules(spark.read.parquet(f"{d}/documents.parquet"), *vocabularies()).where("not base_failed")
    joined = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = {r[0]: r[1] for r in joined}
    assert kept[1] > 0.98 and kept[0] < 0.8


def test_quality_of_sizes_that_few_texts_have(spark):
    from pyspark.sql.types import LongType, StringType, StructType
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and n_chars between 800 and 3000").orderBy("doc_id").select("text").limit(120).collect()]
    rng = random.Random(4)
    soup = " ".join("".join(chr(rng.randrange(0xE000, 0xF000)) for _ in range(4)) for _ in range(3000))
    rows = [*enumerate(texts), (1000, " ".join(texts[:60])), (1001, soup)]
    schema = StructType().add("doc_id", LongType()).add("text", StringType()).add("lang", StringType())

    def judged(rows):
        return by_id(quality.fertility_rules(spark.createDataFrame([(*r, "en") for r in rows], schema), *vocabularies()))

    got = judged(rows)
    assert not got[1001]["base_failed"] and not got[1001]["kept"] and "byte_share" in got[1001]["reasons"]
    assert got[1000]["n_tokens"] > 8 * max(got[i]["n_tokens"] for i in range(120)) and not {"chars_per_token", "byte_share", "entropy_share"} & set(got[1000]["reasons"])
    few = judged([*rows[:10], rows[-1]])
    assert not few[1001]["kept"], "fewer documents than a band needs are one band"


def test_merged_size_classes():
    few = quality.merged_classes({6: 2, 7: 9, 8: 41, 9: 31, 10: 20, 11: 10, 12: 4})
    assert [few[c] for c in (0, 6, 7, 8, 9, 10, 11, 12, 62)] == [6, 6, 6, 6, 9, 10, 10, 10, 10]
    assert set(quality.merged_classes({9: 1}).values()) == {9} and quality.merged_classes({}) == {}
    assert len(quality.merged_classes({4: 30, 40: 30})) == quality.MAX_CLASS + 1
    assert quality.trend([(10, 8, 0.7), (10, 9, 0.65), (10, 10, 0.6), (1, 14, 9.0)]) == pytest.approx(-0.05) and quality.trend([(5, 8, 0.7)]) == 0


def test_token_counts(documents, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = sorted((str(r[0]), len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts.token_counts(documents, path).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.token_counts(documents.limit(0), path).count() == 0


def test_token_counts_odd_strings(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|> y", "\u00a0\u2003\x85 a\u2009b", "\x1c\x1da\x1e", "E\u0301 \u00c9 ΣΟΦΟΣ", "İ ǅ", "'s 're don't 12345 ½", "a\x00b"]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert {r[0]: r[2] for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_line_dedup(spark, documents, rows):
    got = line_dedup.drop_boilerplate(documents)
    assert got.columns == documents.columns + ["__n_lines", "__n_dropped"]
    assert got.count() == len(rows)
    lines = [(i, f"menu line\nown text {i} with some more words of its own\nlegal  " + ("" if i % 3 else "\nrare line"), "h" if i else None) for i in range(40)]
    lines += [(100, "menu line\nlegal", "h"), (101, None, "h"), (102, "", "h"), (103, "menu line\nown", "other"), (104, "menu line\n\nlegal\nand enough words to stay", "h")]
    out = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(lines, "doc_id long, text string, source string"), ratio=0.5).collect()}
    assert out[1]["text"] == "own text 1 with some more words of its own" and out[1]["__n_dropped"] == 2
    assert out[3]["text"] == "own text 3 with some more words of its own\nrare line"
    assert out[0]["text"].startswith("menu line") and out[103]["text"] == "menu line\nown"
    assert out[100]["text"] == "menu line\nlegal", "a text of boilerplate alone stays whole"
    assert out[101]["text"] is None and out[102]["text"] == ""
    assert out[104]["text"] == "\nand enough words to stay"
    assert line_dedup.drop_boilerplate(documents.limit(0)).count() == 0


def test_byte_bpe(documents, rows):
    own = byte_bpe.encode_documents(documents, RANKS, public_tokenizers.PATTERN, spaces_split=True).persist()
    known = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    expected = sorted((str(i), known.encode_ordinary(t or "")) for i, t, *_ in rows)
    got = own.collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == expected
    for r in got:
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest()
    back = byte_bpe.decode_documents(own, RANKS).collect()
    assert sorted((str(a), b) for a, b in back) == sorted((str(i), t or "") for i, t, *_ in rows)
    assert byte_bpe.encode_documents(documents.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_pieces():
    ranks = byte_bpe.read_ranks(RANKS)
    own = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    spaced = byte_bpe._Spaced(byte_bpe._Joined(own), True)
    known = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    parts = ["a", "aa", "the", "th", " ", "  ", "\n", "é", "日本", "😀", "'s", "12", "!!", "\u00a0", "\x1c", "zzzz", "мир", "\u200b"]
    for _ in range(3000):
        s = "".join(rng.choices(parts, k=rng.randrange(20)))
        ids = known.encode_ordinary(s)
        assert own.encode(s) == ids and spaced.ids(s) == ",".join(map(str, ids)) and own.decode(ids) == s.encode()


def test_secret_scan(spark, documents, rows):
    got = secret_scan.secret_spans(documents).collect()
    assert len(got) == len(rows)
    rng = random.Random(4)
    parts = ["token", "TOKEN=", "Secret: ", "apikey='", "=", " ", '"', "AKIA", "ABCDEFGH12345678", "0123abcdef", "deadbeefdeadbeef", "aB3", "xYz/", "é😀", "\n", "password = \"", "abcdefghijklmnop", "ghp_aB3dE5fG7hI9jK1lM3nO"]
    made = [(i, "".join(rng.choices(parts, k=rng.randrange(25))), rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None])) for i in range(400)]
    made += [(9001, None, "a", "x"), (9002, "", "a", "x"), (9003, "token=a " * 3000 + "token=abcdefghijklmnopq", "a", "x"), (9004, "a" * 100_000, "b", "x")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, repo string").withColumn("spans", F.lit("clash"))
    out = by_id(secret_scan.secret_spans(df, repo_col="repo"))
    for i, (base, spans, live, copied) in brute.secrets(made).items():
        assert ([tuple(x) for x in out[i]["base"]], [tuple(x) for x in out[i]["spans"]], out[i]["n_live"], out[i]["n_copied"]) == (base, spans, live, copied)
    digests = by_id(secret_scan.digests(secret_scan.secret_spans(df, repo_col="repo")))
    text = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in brute.secret_base(made[5][1]))
    assert digests[5]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert secret_scan.secret_spans(documents.limit(0)).count() == 0


@pytest.fixture(scope="module")
def benchmark(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    return table.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "too short"), (None, "an item that has no id but has enough words")], table.schema))


def test_decontamination(documents, rows, benchmark):
    out = by_id(decontaminate.contamination(documents, benchmark))
    items = {r[0]: decontaminate.item_words(r[1].encode()) for r in benchmark.collect() if r[1]}
    found = 0
    for i, text in {r[0]: r[1] for r in rows}.items():
        w = decontaminate.item_words((text or "").encode())
        if len(w) > 600:
            continue
        expected = {k for k, x in items.items() if len(x) >= 6 and set(x) & set(w) and brute.word_edit_distance(x, w) <= decontaminate.edits(len(x))}
        assert set(out[i]["item_ids"]) == expected
        found += len(expected)
    assert found >= 3
    assert decontaminate.contamination(documents.limit(0), benchmark).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(documents, benchmark.limit(0)).collect())
    kept = decontaminate.drop_contaminated(documents, benchmark)
    assert kept.columns == documents.columns and kept.count() == sum(not out[r[0]]["contaminated"] for r in rows)


def test_decontamination_by_blocks(monkeypatch, documents, benchmark):
    whole = {(r["doc_id"], tuple(r["item_ids"])) for r in decontaminate.contamination(documents, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    assert {(r["doc_id"], tuple(r["item_ids"])) for r in decontaminate.contamination(documents, benchmark).collect()} == whole


def test_decontamination_recall(benchmark):
    items = [(i, t.encode()) for i, t in benchmark.collect() if t and i is not None]
    search = decontaminate.Items(items)
    rng = random.Random(1)
    other = [f"q{k}".encode() for k in range(500)]
    texts, wanted = [], []
    for i, t in items * 5:
        w = decontaminate.item_words(t)
        if len(w) < decontaminate.MIN_ITEM_WORDS:
            continue
        e = decontaminate.edits(len(w))
        for _ in range(e):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at:at + (kind != 1)] = [rng.choice(other)] if kind < 2 else []
        texts.append(b" ".join(rng.choices(other, k=30) + w + rng.choices(other, k=30)))
        wanted.append(i)
    got = search.search(texts)
    assert sum(i in {m[0] for m in x} for i, x in zip(wanted, got, strict=True)) >= 0.95 * len(wanted)


def test_decontamination_of_texts_that_begin_inside_an_item(benchmark):
    items = [(i, t.encode()) for i, t in benchmark.collect() if t and i is not None]
    search = decontaminate.Items(items)
    rng = random.Random(2)
    other = [f"q{k}".encode() for k in range(500)]
    texts, wanted = [], []
    for i, t in items:
        w = decontaminate.item_words(t)
        if len(w) < decontaminate.MIN_ITEM_WORDS:
            continue
        for cut in range(1, decontaminate.edits(len(w)) + 1):
            texts.append(b" ".join(w[cut:] + rng.choices(other, k=rng.randrange(40))))
            wanted.append((i, cut))
    for got in (search.search(texts), [search.search([t])[0] for t in texts]):  # after other texts, and as a slice's first
        best = [min((m for m in x if m[0] == i), key=lambda m: m[3], default=None) for (i, _), x in zip(wanted, got, strict=True)]
        assert sum(m is not None for m in best) >= 0.95 * len(wanted)
        assert all(m[1] == 0 and m[3] <= cut for m, (_, cut) in zip(best, wanted, strict=True) if m)


def test_ngram_join(documents, rows, distinct):
    got = ngram_join.jaccard_components(documents).collect()
    assert len(got) == len(rows)
    expected = brute.components(distinct)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
        else:
            assert r["component_id"] is None
    assert {r["doc_id"]: r["component_id"] for r in got}[10_009] == 10_004, "letters in either case"
    kept = ngram_join.one_of_each(documents)
    assert kept.columns == documents.columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted([str(i) for i, (_, c) in expected.items() if c == i] + ["None"])


def test_ngram_join_of_a_large_near_group(spark):
    """Copies that drift from one text, with chains that only pairs of them link, and an empty table."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    made = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(40)}"
        made.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.components(made).items()}
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_join_links_are_as_many_as_groups(spark, monkeypatch):
    """Near copies that come apart into many groups melt together by few links, and no link between others is lost."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    made = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(2, 6)):
            w[rng.randrange(150)] = f"x{rng.randrange(30)}"
        made.append((i, " ".join(w)))
    seen = []
    plain = ngram_join._links_across
    monkeypatch.setattr(ngram_join, "_links_across", lambda *a: seen.append(plain(*a)) or seen[-1])
    monkeypatch.setattr(ngram_join, "MIN_HASHES", 1)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.components(made).items()}
    links = seen[0].collect()
    groups = {x for r in links for x in r}
    assert len(links) == len({tuple(r) for r in links}) and len(links) <= 3 * max(1, len(groups))


def test_ngram_join_of_near_copies_that_do_not_link(spark, monkeypatch):
    """Near copies that link with each other beside others that share their words and link with nothing: rows of blocks, not of pairs."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    made = []
    for i in range(360):
        w = list(base)
        for j in rng.sample(*((range(6, 72, 6), 1) if i < 300 else (range(78, 150, 6), 3))):
            w[j] = f"x{i}_{j}"
        made.append((i, " ".join(w)))
    seen = []
    plain = ngram_join._links_across
    monkeypatch.setattr(ngram_join, "_links_across", lambda *a: seen.append(a[0].count()) or plain(*a))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.components(made).items()}
    assert len(set(got.values())) > 40
    assert seen[0] <= len(made)


def test_suffix_dedup(documents, rows):
    short = documents.where("doc_id is null or doc_id not in (10005, 10006)")
    got = suffix_dedup.repeated_substrings(short).collect()
    # the repeated row is a text that occurs once more
    texts = [(k, r[1]) for k, r in enumerate(rows) if r[0] not in (10_005, 10_006)]
    expected = brute.removed_bytes(texts)
    want = sorted((str(rows[k][0]), n, gone, spans, hashlib.sha256(kept).hexdigest()) for k, (n, gone, spans, kept) in expected.items())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got) == want
    assert sum(x[2] for x in want) > 5000
    assert suffix_dedup.repeated_substrings(documents.limit(0)).count() == 0


def test_suffix_dedup_of_one_byte(spark):
    got = by_id(suffix_dedup.repeated_substrings(spark.createDataFrame([(1, "x" * 5000), (2, "y" * 199), (3, "ab" * 150)], "doc_id long, text string")))
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (5000, 0, 300)


@pytest.mark.parametrize("seed", range(6))
def test_difference_cover_order(seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    for _ in range(60):
        s = rng.integers(1, int(rng.choice([2, 3, 5, 60])), int(rng.integers(0, 80)))
        span = int(rng.choice([1, 2, 3, 8, 25, 90]))
        order = suffix_dedup.difference_cover_order(s, span).tolist()
        keys = [tuple(s[i:i + span].tolist()) for i in order]
        assert sorted(order) == list(range(len(s))) and keys == sorted(keys)


def test_url_rules(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "www.example.com", "b.WWW.example.com", "x.net", "net", "spam.example.org", "fine.example.org", "com", "notcom", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['/en/', '/en', '/es/x', '/fr/?q', '', '/de/1#top', '?a=/es/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "HTTP://A.COM/EN/ü?x#y", "http://h.net/es/\nline", "x://y://net/es/"]
    pages = spark.createDataFrame([(i if i else None, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    blocked = [(u, None if rng.random() < 0.1 else "spam" in u) for u in urls if u]
    labelled = spark.createDataFrame(blocked + [(None, True)], "url string, blocked boolean")
    got = {r["page_id"]: r for r in url_rules.judge_urls(pages, labelled, min_support=0.02).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute.url_verdict(u, url_rules.HOST_RULES)
        r = got[i if i else None]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if host == "spam.example.org" else "allow"))
    rules = url_rules.mine(labelled, min_support=0.02).collect()
    assert rules and all("h:spam.example.org" in r["tokens"] and r["anchor"] in r["tokens"] and r["confidence"] >= 0.8 for r in rules)
    assert url_rules.judge_urls(pages.limit(0), labelled).count() == 0
    alone = url_rules.judge_urls(pages, labelled.limit(0)).where("rule is null").select("verdict").distinct().collect()
    assert [r[0] for r in alone] == ["allow"]


def test_url_rules_need_more_than_a_few_labels(spark):
    once = [(f"http://h{i}.org/p{i}/odd{i}", i < 2) for i in range(40)]
    assert url_rules.mine(spark.createDataFrame(once, "url string, blocked boolean")).count() == 0
    often = once + [("http://bad.org/x", True)] * 6 + [(f"http://good.org/{i}", False) for i in range(30)]
    rules = url_rules.mine(spark.createDataFrame(often, "url string, blocked boolean")).collect()
    assert rules and all(set(r["tokens"]) <= {"h:bad.org", "p:x", "h:org"} for r in rules)
    long = "http://h.org/" + "/".join("s" * 50 for _ in range(2000)) + "?" + "&".join(f"k{i}=1" for i in range(500))
    got = url_rules.judge_urls(spark.createDataFrame([(1, long)], "page_id long, url string"), spark.createDataFrame(often, "url string, blocked boolean")).first()
    assert got["verdict"] == "allow" and got["host"] == "h.org" and len(got["path"]) > 100_000


def test_slices_hold_one_slice_of_a_batch_at_a_time():
    """A task's Python memory follows the slice, not the batch, however wide its rows."""
    import tracemalloc

    import pyarrow as pa

    from cohortlens.llm.common import slices

    texts = [b"", b"x" * 3_000_000] + [bytes([65 + i % 26]) * 50_000 for i in range(800)] + [b"", b"end"]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(texts))], pa.int64()), pa.array(texts, pa.binary())], names=["__id", "__bytes"])
    found, sizes = [], []
    tracemalloc.start()
    for ids, part in slices([batch.slice(0, 0), batch.slice(0, 500), batch.slice(500)], 1_000_000):
        sizes.append(sum(map(len, part)) if len(part) > 1 else 0)
        found += [(i, len(t), t[:1]) for i, t in zip(ids, part, strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(i or None, len(t), t[:1]) for i, t in enumerate(texts)]
    assert max(sizes) <= 1_000_000 and peak < 10_000_000


@pytest.mark.parametrize("n", [10, 46, 47, 300, 20_000])
def test_hash_functions_of_a_region_go_together(n, monkeypatch):
    """The least hashes of all functions come from two passes over a region, not two per function; long regions take few functions at a time."""
    import numpy as np
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, 3 * n, n).astype(np.uint64)
    tokens[rng.random(n) < 0.1] |= substring_dedup._ONCE
    sliding, passes = substring_dedup.sliding, []
    monkeypatch.setattr(substring_dedup, "sliding", lambda x, *a: passes.append(len(x)) or sliding(x, *a))
    got = substring_dedup.signature_values(tokens, 46, 8)
    assert len(passes) <= (2 if n <= 300 else 6) and max(passes, default=0) <= 1 << 17
    values, ranges = set(), np.zeros((8, max(0, n - 45)), np.int64)
    for j in range(8):
        h = substring_dedup.mix(tokens ^ np.uint64(0xC3C3_0001 * (j + 1)))
        for start in range(max(0, n - 45)):
            c = start + int(h[start:start + 46].argmin())
            ranges[j, start] = int((int(h[c]) >> 8 << 4 | j) & (2**64 - 1)) - (2**64 if (int(h[c]) >> 8 << 4) >> 63 & 1 else 0)
            if not tokens[c] & substring_dedup._ONCE:
                values.add(int(ranges[j, start]))
    assert got.tolist() == sorted(values)
    for share in (0.2, 0.5, 0.8):
        some = np.sort(got[rng.random(len(got)) < share])
        if len(some):
            most = np.isin(ranges, some).sum(axis=0).max()
            assert [substring_dedup.meet_at_one(tokens, some, 46, 8, e) for e in range(1, 9)] == [bool(most >= e) for e in range(1, 9)]
