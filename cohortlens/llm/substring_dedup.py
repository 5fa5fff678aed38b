"""Near-duplicate passages by compact windows.

A passage is MIN_WORDS words or more; two passages are near duplicates if the
Jaccard similarity of their five-word shingles is at least 0.8. Every passage
that is reported is a union of windows of MIN_WORDS words that were verified.

For one hash function, the Cartesian tree over the hashes of a token sequence
groups all its subsequences by their min-hash: the node with the least hash of
[L, R] stands for every subsequence that starts in [L, C] and ends in [C, R].
Only nodes whose interval is as long as a passage are made (about 2n / length
of them). Subsequences of two texts share a signature where nodes of an equal
least hash meet; a pair whose intervals meet at one subsequence under enough
hash functions is a candidate and is verified shingle by shingle.

1. ``shared_items`` says which shingles occur twice or more. A window of n
   shingles has a near duplicate as long only if 2 * 0.8 / 1.8 * n of them do;
   such windows make the regions. Equal regions (copied texts and passages)
   become one class.
2. Compact windows of each class, under HASHES hash functions; what is sent is
   the least hash and the class.
3. Each least hash has a hub, the longest region that others share most of;
   every other region meets the hub first, not all others. What verifies is
   explained.
4. Windows that no hub explained meet a hub among those that are still left:
   variants that have a change in common meet there by the shingles of the
   change.
5. Then nothing is left to hubs. A near duplicate of a window lacks at most
   ``length - needed`` of its places, so it has one of its rarest
   ``length - needed + 1`` shingles. By these each window that is not explained
   meets every region that could hold a near duplicate of it, and so do windows
   of regions that no chain of verified passages links yet: first one pair for
   each two chains, then all pairs of those that still are two. A pair left out
   says nothing new: its windows are explained and its regions are linked. Pairs
   grow as the square of regions that share rare shingles and do not verify.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import connected_components, dropped, keyed_text, saved
from cohortlens.llm.shared_items import shared_items
from cohortlens.llm.suffix_dedup import sliding
from cohortlens.llm.words import WordHashes, mix, shingles

MIN_WORDS, SHINGLE, PERCENT = 50, 5, 80
HASHES, ENOUGH = 8, 4
#: A hub is the longest region, each shingle that occurs once counting against it by this many: near copies then meet what they were copied from.
ONCE_COSTS = 10
#: How many shingles an aligned passage may be shifted by insertions or deletions between two matches.
DRIFT = 12
_META = np.dtype([("id", "i8"), ("null", "u1"), ("n_words", "u4"), ("n", "u4")])
_SPANS = "array<struct<start:int,end:int>>"
#: Spans of shingles, those whose words touch or overlap as one: what a class with many copies is then given has no row per pair.
_MERGED = f"""aggregate(array_sort(collect_set(s)), cast(array() as {_SPANS}), (m, x) -> if(x.start <= try_element_at(m, -1).end + {SHINGLE - 1},
    concat(slice(m, 1, size(m) - 1), array(named_struct('start', try_element_at(m, -1).start, 'end', greatest(try_element_at(m, -1).end, x.end)))),
    concat(m, array(x))))"""


def _extract(size: int):
    hashes = WordHashes()

    def extract(ids, texts):
        meta, found = np.zeros(len(ids), _META), []
        for i, (key, text) in enumerate(zip(ids, texts, strict=True)):
            words = text.lower().split()
            s = shingles(hashes.of(words), size)
            meta[i] = (key or 0, key is None, len(words), len(s))
            found.append(s)
        items = np.concatenate(found) if found else np.zeros(0, np.uint64)
        return meta, items, np.arange(len(items), dtype=np.uint64), len(items)

    return extract


#: Marks a shingle that occurs once; shingles that repeat have this bit clear.
_ONCE = np.uint64(1 << 63)


def needed(length: int, percent: int) -> int:
    """Least number of common shingles of two windows of ``length`` with a similarity of ``percent``."""
    return -(-2 * percent * length // (100 + percent))


def dense_windows(shared: np.ndarray, length: int, least: int) -> np.ndarray:
    """Places where a window of ``length`` with ``least`` shared ones starts."""
    if len(shared) < length:
        return np.zeros(0, np.int64)
    total = np.r_[0, np.cumsum(shared)]
    return np.flatnonzero(total[length:] - total[:-length] >= least)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def _regions(length: int, percent: int):
    least = needed(length, percent)

    def per_block(block, meta, where, items, code):
        ends = np.cumsum(meta["n"].astype(np.int64))
        cut = np.searchsorted(where, np.r_[0, ends])
        out = []
        for i, (n, end) in enumerate(zip(meta["n"].tolist(), ends.tolist(), strict=True)):
            row, key = (block << 20) + i, None if meta["null"][i] else int(meta["id"][i])
            a, b = cut[i], cut[i + 1]
            runs = []
            if b - a >= least:
                at = where[a:b].astype(np.int64) - (end - n)
                shared = np.zeros(n, bool)
                shared[at] = True
                token = mix((np.uint64(row & 0xFFFFFFFFFFF) << np.uint64(20)) + np.arange(n, dtype=np.uint64)) | _ONCE
                token[at] = items[a:b] & ~_ONCE
                often = np.zeros(n, np.uint8)
                often[at] = code[a:b]
                runs = _runs(covered(dense_windows(shared, length, least), length, n))
            out += [(key, row, int(meta["n_words"][i]), r["start"], r["end"] - r["start"], token[r["start"]:r["end"]].tobytes(), often[r["start"]:r["end"]].tobytes()) for r in runs] \
                or [(key, row, int(meta["n_words"][i]), None, None, None, None)]
        frame = pd.DataFrame(out, columns=["id", "row", "n_words", "start", "n", "seq", "often"])
        return frame.astype({"id": "Int64", "start": "Int64", "n": "Int64"})

    return per_block


def least_places(hashes: np.ndarray, length: int) -> np.ndarray:
    """Places that are the least of some ``length`` neighbours: the nodes of the Cartesian tree that span as many, with those that tie with one."""
    return np.flatnonzero(_least(hashes[None, :], length)[0])


def _lows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Least hash of each ``length`` neighbours, row by row of ``hashes`` (functions, places); the rows lie end to end, and what spans two is left out."""
    rows, n = hashes.shape
    out = np.zeros(rows * n, np.uint64)
    out[:rows * n - length + 1] = sliding(hashes.reshape(-1), length, np.minimum, (1 << 64) - 1)
    return out.reshape(rows, n)[:, :n - length + 1]


def _least(hashes: np.ndarray, length: int) -> np.ndarray:
    """Which places are the least of some ``length`` neighbours, row by row of ``hashes`` (functions, places)."""
    rows, n = hashes.shape
    if n < length:
        return np.zeros(hashes.shape, bool)
    low = np.zeros((rows, n + length - 1), np.uint64)
    low[:, length - 1:n] = _lows(hashes, length)
    most = np.zeros(low.size, np.uint64)
    most[:low.size - length + 1] = sliding(low.reshape(-1), length, np.maximum, 0)
    return most.reshape(low.shape)[:, :n] == hashes


def compact_windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """(L, C, R) of the Cartesian tree's nodes over ``hashes`` that span at least ``length`` places, R included; the first of equal hashes is the root.

    What ends a node's interval is a node above it, which spans more. So the
    tree over the places of ``least_places`` has the same intervals, and a
    stack over these few places makes it.
    """
    at = least_places(hashes, length)
    value = hashes[at].tolist()
    places = at.tolist()
    left, right, stack = [0] * len(places), [len(hashes) - 1] * len(places), []
    for k, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = places[k] - 1
        left[k] = places[stack[-1]] + 1 if stack else 0
        stack.append(k)
    out = np.array([left, places, right], np.int64).T.reshape(-1, 3)
    return out[out[:, 2] - out[:, 0] + 1 >= length]


#: (function, place) hashes made at a time, or one function's.
HASHED_CELLS = 1 << 16


def _hashed(tokens: np.ndarray, hashes: int):
    """(functions, hashes of the tokens under each of them), few functions at a time where there are many tokens."""
    step = max(1, HASHED_CELLS // max(1, len(tokens)))
    for first in range(0, hashes, step):
        js = np.arange(first, min(first + step, hashes), dtype=np.uint64)
        yield js, mix(tokens ^ (np.uint64(0xC3C3_0001) * (js + np.uint64(1)))[:, None])


def _value(h: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What is compared: a least hash, its last bits naming the hash function."""
    return ((h >> np.uint64(8)) << np.uint64(4) | j).astype(np.int64)


def signature_values(tokens: np.ndarray, length: int, hashes: int, where: np.ndarray | None = None) -> np.ndarray:
    """Distinct least hashes of the windows under each hash function whose least token repeats (and stands where ``where`` says)."""
    keep = tokens & _ONCE == 0
    if where is not None:
        keep &= where
    out = []
    for js, h in _hashed(tokens, hashes):
        j, c = np.nonzero(_least(h, length) & keep)
        out.append(_value(h[j, c], js[j]))
    return np.unique(np.concatenate(out))


def _values(length: int, hashes: int):
    def run(frames):
        for pdf in frames:
            out, scores = [np.zeros(0, np.int64)], []
            for blob in pdf["seq"]:
                tokens = np.frombuffer(blob, np.uint64)
                scores.append(len(tokens) - ONCE_COSTS * int((tokens & _ONCE != 0).sum()))
                out.append(signature_values(tokens, length, hashes))
            many = [len(v) for v in out[1:]]
            yield pd.DataFrame({"value": np.concatenate(out), "rid": np.repeat(pdf["rid"].to_numpy(np.int64), many), "score": np.repeat(np.array(scores, np.int64), many)})

    return run


def compact_starts(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least hash, how many) of the runs of starts whose subsequences of ``length`` places have the same least hash: what each compact window holds of that length, side by side."""
    low = sliding(hashes, length, np.minimum, (1 << 64) - 1)
    heads = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return low[heads], np.diff(np.r_[heads, len(low)])


def meet_at_one(tokens: np.ndarray, values: np.ndarray, length: int, hashes: int, enough: int) -> bool:
    """Whether some subsequence of ``length`` places lies in compact windows of ``enough`` hash functions whose least hashes are among ``values`` (sorted).

    A compact window (L, C, R) holds the subsequences that start from
    max(L, C - length + 1) to min(C, R - length + 1). For one function these
    ranges lie side by side, one for each run of equal least hashes, so the
    windows need not be made: the functions that agree are counted by start.
    """
    if len(tokens) < length:
        return False
    agree = np.zeros(len(tokens) - length + 1, np.int64)
    for js, h in _hashed(tokens, hashes):
        low = _lows(h, length)
        j, head = np.nonzero(np.column_stack([np.ones(len(js), bool), low[:, 1:] != low[:, :-1]]))
        v = _value(low[j, head], js[j])
        found = values[np.minimum(np.searchsorted(values, v), len(values) - 1)] == v
        agree += np.repeat(found, np.diff(np.r_[j * low.shape[1] + head, low.size])).reshape(low.shape).sum(axis=0)
        most, left = int(agree.max()), hashes - 1 - int(js[-1])
        if most >= enough or most + left < enough:
            return most >= enough
    return False


def _chains(places: np.ndarray) -> np.ndarray:
    """(first, last) of the runs of rising ``places`` whose neighbours are at most DRIFT apart."""
    cut = np.flatnonzero(np.diff(places) > DRIFT)
    return np.stack([places[np.r_[0, cut + 1]], places[np.r_[cut, len(places) - 1]]], 1)


def _joined(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of diagonals that are at most DRIFT apart as one."""
    by = np.argsort(low, kind="stable")
    low, top = low[by], np.maximum.accumulate(high[by])
    cut = np.flatnonzero(low[1:] - top[:-1] > DRIFT) + 1
    return low[np.r_[0, cut]], top[np.r_[cut - 1, len(low) - 1]]


def _listed_bands(a, hit, low, high, order, least: float, apart: int = 0):
    """Per band of diagonals, what each place of ``a`` meets there; every match is listed."""
    many = high[hit] - low[hit]
    p = np.repeat(hit, many)
    q = order[np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[hit], many)]
    if apart:
        far = np.abs(q - p) >= apart
        p, q = p[far], q[far]
    diagonal, p = np.divmod(np.sort((q - p) * len(a) + p), len(a))
    q = p + diagonal
    bands = np.r_[0, np.flatnonzero(np.diff(diagonal) > DRIFT) + 1, len(p)]
    for x, y in zip(bands[:-1], bands[1:], strict=True):
        if y - x >= least:
            to = np.full(len(a), -1, np.int64)
            to[p[x:y]] = q[x:y]
            yield to


def _unlisted_bands(a, hit, low, high, order, least: float, apart: int = 0):
    """The bands of ``_listed_bands`` where the matches are too many to list.

    The diagonals of a run of one token's places in ``a`` and one in ``b`` are
    at most DRIFT apart, so the runs' ends say which band they are in, and
    what a place meets in a band is found by searching. Memory is linear.
    """
    first, last = np.zeros(0, np.int64), np.zeros(0, np.int64)
    token, size = low[hit], len(order) + len(a)
    by = np.argsort(token, kind="stable")
    for places in np.split(hit[by], np.flatnonzero(np.diff(token[by])) + 1):
        ours, theirs = _chains(places), _chains(order[low[places[0]]:high[places[0]]])
        for step in range(0, len(ours), max(1, size // len(theirs))):
            x = ours[step:step + max(1, size // len(theirs))]
            first = np.concatenate([first, (theirs[:, 0] - x[:, 1:]).reshape(-1)])
            last = np.concatenate([last, (theirs[:, 1] - x[:, :1]).reshape(-1)])
            if len(first) > size:
                first, last = _joined(first, last)
    # places of b by token; a token's key is where its places begin
    width = np.int64(len(order) + 1)
    heads, nth = np.unique(token, return_index=True)
    counts = high[hit[nth]] - heads
    at = np.repeat(heads, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    place = np.repeat(heads, counts) * width + order[at]
    base = token * width
    bands = list(zip(*_joined(first, last), strict=True))
    if apart:
        bands = [b for x, y in bands for b in ((x, min(y, -apart)), (max(x, apart), y)) if b[0] <= b[1]]
    for x, y in bands:
        begin = np.searchsorted(place, base + np.clip(hit + x, 0, width - 1), "left")
        end = np.searchsorted(place, base + np.clip(hit + y, -1, width - 2), "right")
        found = end > begin
        if int((end - begin)[found].sum()) >= least:
            to = np.full(len(a), -1, np.int64)
            to[hit[found]] = place[end[found] - 1] % width
            yield to


#: So many matches for each place of two passages are listed one by one.
LISTED = 50


def near_duplicate_places(a: np.ndarray, b: np.ndarray, length: int, percent: int, apart: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the places of ``a`` and ``b`` in windows of ``length`` shingles of ``a`` that are near duplicates of the aligned window of ``b``, which is ``apart`` places off at least.

    Where the same tokens stand over and over, a place of ``a`` has many that
    it can be aligned with; the windows of ``b`` are then looked for in ``a`` as well.
    """
    in_a, in_b, many = _places(a, b, length, percent, apart)
    if many and a is not b:
        of_b, of_a, _ = _places(b, a, length, percent, apart)
        in_a, in_b = in_a | of_a, in_b | of_b
    return in_a, in_b


def _places(a: np.ndarray, b: np.ndarray, length: int, percent: int, apart: int) -> tuple[np.ndarray, np.ndarray, bool]:
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    order = np.argsort(b, kind="stable")
    s = b[order]
    low, high = np.searchsorted(s, a, "left"), np.searchsorted(s, a, "right")
    # every alignment is a diagonal: places of equal tokens whose difference is the same, give or take DRIFT
    hit = np.flatnonzero(high > low)
    least = percent * length / 100
    if len(hit) < least:
        return in_a, in_b, False
    many = int((high - low).sum()) > LISTED * (len(a) + len(b))
    if not len(dense_windows(high > low, length, needed(length, percent))):
        return in_a, in_b, many
    for to in (_unlisted_bands if many else _listed_bands)(a, hit, low, high, order, least, apart):
        some = np.r_[0, np.cumsum(to >= 0)]
        start = np.arange(len(a) - length + 1)
        m = some[length:] - some[:-length]
        ok = start[100 * m >= percent * length]
        if not len(ok):
            continue
        hits = np.flatnonzero(to >= 0)
        f, last = hits[some[ok]], hits[some[ok + length] - 1]
        qa, qb = to[f] - (f - ok), to[last] + (ok + length - 1 - last)
        qa, qb = np.maximum(qa, 0), np.minimum(qb, len(b) - 1)
        wide = np.maximum(qb - qa + 1, length)  # the other passage is as long at least
        fits = (wide > 0) & (100 * m[ok] >= percent * (length + wide - m[ok]))
        in_a |= covered(ok[fits], length, len(a))
        fits &= qb >= qa  # places that go back are no passage of b
        edge = np.zeros(len(b) + 1, np.int64)
        np.add.at(edge, qa[fits], 1)
        np.add.at(edge, qb[fits] + 1, -1)
        in_b |= np.cumsum(edge)[:-1] > 0
    return in_a, in_b, many


def _runs(mask: np.ndarray) -> list[dict]:
    change = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)]


def _verify(length: int, percent: int, hashes: int, enough: int):
    """Spans of the first region of each pair whose windows meet at one subsequence (with ``enough`` 0: of any pair) and that verify; a hub's own spans come once for all pairs that follow each other, in a row (hub, hub)."""
    def run(frames):
        hub, values, known = None, None, np.zeros(0, bool)
        names = ["a", "b", "in_a", "in_b"]
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.frombuffer(r.seq, np.uint64), np.frombuffer(r.hub_seq, np.uint64)
                if r.hub != hub:
                    if known.any():
                        out.append((hub, hub, [], _runs(known)))
                    hub, values, known = r.hub, signature_values(b, length, hashes) if enough else None, np.zeros(len(b), bool)
                if enough and (not len(values) or not meet_at_one(a, values, length, hashes, enough)):
                    continue
                in_a, in_b = near_duplicate_places(a, b, length, percent)
                if in_a.any():
                    known |= in_b
                    out.append((r.rid, hub, _runs(in_a), []))
            yield pd.DataFrame(out, columns=names)
        if known.any():
            yield pd.DataFrame([(hub, hub, [], _runs(known))], columns=names)

    return run


def _within(length: int, percent: int):
    """Spans of the regions that hold near duplicates of windows of their own, which no word is in common with."""
    def run(frames):
        for pdf in frames:
            out = []
            for rid, seq in zip(pdf["rid"], pdf["seq"], strict=True):
                a = np.frombuffer(seq, np.uint64)
                order = np.argsort(a, kind="stable")
                twin = np.zeros(len(a), bool)       # has an equal further left or right
                same = a[order][1:] == a[order][:-1]
                twin[order[1:][same]] = twin[order[:-1][same]] = True
                if len(dense_windows(twin, length, needed(length, percent))):
                    in_a, in_b = near_duplicate_places(a, a, length, percent, length + SHINGLE - 1)
                    if in_a.any():
                        out.append((rid, rid, _runs(in_a | in_b), []))
            yield pd.DataFrame(out, columns=["a", "b", "in_a", "in_b"])

    return run


def _left_over(length: int, percent: int, hashes: int):
    """Values of the compact windows whose least token lies in a window that could have a near duplicate and is not explained."""
    least = needed(length, percent)

    def run(frames):
        for pdf in frames:
            out, rids = [np.zeros(0, np.int64)], []
            for rid, seq, spans in zip(pdf["rid"], pdf["seq"], pdf["spans"], strict=True):
                tokens = np.frombuffer(seq, np.uint64)
                known = np.zeros(len(tokens), bool)
                for s in (spans if spans is not None else ()):
                    known[s["start"]:s["end"]] = True
                if known.all():
                    continue
                starts = dense_windows(tokens & _ONCE == 0, length, least)
                inside = np.r_[0, np.cumsum(known)]
                starts = starts[inside[starts + length] - inside[starts] < length]
                if len(starts):
                    out.append(signature_values(tokens, length, hashes, covered(starts, length, len(tokens))))
                    rids.append(rid)
            yield pd.DataFrame({"value": np.concatenate(out), "rid": np.repeat(np.array(rids, np.int64), [len(v) for v in out[1:]])})

    return run


#: Cells (window, place) that are ranked at a time.
RANKED_CELLS = 1 << 20


def rare_places(tokens: np.ndarray, often: np.ndarray, length: int, most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each place, and for each of ``most`` the rank up to which a place is among so many rarest ones of a window of ``length``, window by window.

    What occurs once comes before all others and ties go by the token, so all texts rank tokens alike.
    """
    shared = tokens & _ONCE == 0
    order = np.lexsort((np.where(shared, mix(tokens), 0), np.where(shared, often, 0)))
    rank = np.empty(len(tokens), np.uint16 if len(tokens) < 1 << 16 else np.uint32)
    rank[order] = np.arange(len(tokens), dtype=rank.dtype)
    windows = np.lib.stride_tricks.sliding_window_view(rank, length)
    step, kth = max(1, RANKED_CELLS // length), [m - 1 for m in most]
    return rank, np.concatenate([np.partition(windows[i:i + step], kth, axis=1)[:, kth] for i in range(0, len(windows), step)]).T


def answers(length: int, percent: int) -> int:
    """So many places at most of a passage that is a near duplicate of a window of ``length`` are not in the window, and one more."""
    longest = 100 * length // percent
    return 1 + max(wide - -(-percent * (length + wide) // (100 + percent)) for wide in range(length, longest + 1))


def asked_tokens(tokens: np.ndarray, often: np.ndarray, known: np.ndarray, length: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, kind): what a text must share at least one of to hold a near duplicate of a window.

    A near duplicate lacks at most ``length - needed`` places of a window, so
    it has one of the rarest ``length - needed + 1``. Kind 2: such a token of
    a window that is not explained, 1: of any other that could have a near
    duplicate, 0: a token by which this text can answer only.
    """
    asks, replies = length - needed(length, percent) + 1, answers(length, percent)
    shared = tokens & _ONCE == 0
    rank, (few, more) = rare_places(tokens, often, length, [asks, replies])
    dense = dense_windows(shared, length, needed(length, percent))
    inside = np.r_[0, np.cumsum(known)]
    unknown = dense[inside[dense + length] - inside[dense] < length]

    def rare(bound, windows):
        """Places that are rare in one of the windows."""
        b = np.zeros(len(tokens) + length - 1, np.int64)
        b[length - 1 + windows] = bound[windows].astype(np.int64) + 1
        return sliding(b, length, np.maximum, 0) > rank

    kind = np.where(rare(few, unknown), 2, np.where(rare(few, dense), 1, np.where(rare(more, np.arange(len(more))), 0, -1)))
    at = np.flatnonzero((kind >= 0) & shared)
    by = at[np.lexsort((-kind[at], tokens[at]))]
    first = np.r_[True, tokens[by][1:] != tokens[by][:-1]][:len(by)]
    return tokens[by[first]], kind[by[first]].astype(np.int8)


def _asked(length: int, percent: int):
    def run(frames):
        for pdf in frames:
            out, kinds, many = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], []
            for seq, often, spans in zip(pdf["seq"], pdf["often"], pdf["spans"], strict=True):
                tokens = np.frombuffer(seq, np.uint64)
                known = np.zeros(len(tokens), bool)
                for s in (spans if spans is not None else ()):
                    known[s["start"]:s["end"]] = True
                found, kind = asked_tokens(tokens, np.frombuffer(often, np.uint8), known, length, percent)
                out.append(found)
                kinds.append(kind)
                many.append(len(found))
            yield pd.DataFrame({"token": np.concatenate(out).view(np.int64), "rid": np.repeat(pdf["rid"].to_numpy(np.int64), many),
                                "kind": np.concatenate(kinds), "root": np.repeat(pdf["root"].to_numpy(np.int64), many)})

    return run


def _pairs(left: DataFrame, right: DataFrame, enough: int) -> DataFrame:
    """(rid, hub) that share a least hash under enough functions."""
    return left.join(right, "value").where("rid <> hub").groupBy("rid", "hub") \
        .agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(value & 15 as int))"))).alias("js")).where(F.col("js") >= enough).select("rid", "hub")


def _asks(classes: DataFrame, length: int, percent: int) -> DataFrame:
    """(rid, hub) where a window of ``rid`` and one of ``hub`` may be near duplicates that would say something new: the window is not explained
    (``open``) or the two have different roots (``least``, ``most``). ``tokens``: how many of those asked for they share."""
    asked = saved(classes.select("rid", "seq", "often", "spans", "root").mapInPandas(_asked(length, percent), "token long, rid long, kind byte, root long"))
    told = asked.groupBy("token").agg(F.count("*").alias("n"), F.max("kind").alias("most"), F.min("root").alias("a"), F.max("root").alias("b")) \
        .where("n > 1 and (most = 2 or (most = 1 and a <> b))").select("token")
    some = saved(asked.join(told, "token"))
    left, right = some.where("kind > 0").withColumnRenamed("kind", "asks"), some.select("token", F.col("rid").alias("hub"), F.col("root").alias("hub_root"))
    return left.join(right, "token").where("rid <> hub and (asks = 2 or root <> hub_root)").groupBy("rid", "hub") \
        .agg(F.count("*").alias("tokens"), (F.max("asks") == 2).alias("open"), F.min(F.least("root", "hub_root")).alias("least"), F.max(F.greatest("root", "hub_root")).alias("most"))


def _linked(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (rid, root) after the links that were ``found``: only roots are walked again."""
    r = roots.withColumnRenamed("root", "r")
    edges = found.select("a", "b").where("a <> b").join(r.select(F.col("rid").alias("a"), F.col("r").alias("ra")), "a", "left").join(
        r.select(F.col("rid").alias("b"), F.col("r").alias("rb")), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = saved(connected_components(edges))
    return r.join(moved.select(F.col("node").alias("r"), "root"), "r", "left").select("rid", F.coalesce("root", "r").alias("root")) \
        .union(moved.select(F.col("node").alias("rid"), "root").join(r.select("rid"), "rid", "left_anti"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                      percent: int = PERCENT, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_repeated`` (words in passages that have a near duplicate elsewhere, or further on in the same text), ``n_dropped`` (those of them that are not the class's first), ``class_ids``, ``spans``.

    ``spans`` are arrays of (start, end, class_id, first): words from and to,
    the smallest document id with a passage of the class, and whether this
    region is the one that stays. Words are runs other than ASCII white space,
    A-Z lower-cased. Regions link if one verified passage links them. What
    a region repeats of itself counts as repeated, and stays with the region. Texts that are null, empty
    or shorter than a passage have no spans. Rows without an id count like
    others but give no class id. Repeated rows are copies of each other. Other
    columns are not read. An empty table gives no rows.
    """
    length = min_words - SHINGLE + 1
    rows = saved(shared_items(keyed_text(docs, id_col, text_col), _extract(SHINGLE), _META, _regions(length, percent),
                              "id long, row long, n_words long, start long, n long, seq binary, often binary")
                 .withColumn("rid", F.when(F.col("seq").isNotNull(), F.xxhash64("seq", "n"))))
    classes = saved(rows.where("rid is not null").select("rid", "n", "seq", "often").dropDuplicates(["rid"]))
    whole_rows, rows = rows, saved(rows.drop("seq", "often"))
    dropped(whole_rows)
    regions = rows.where("rid is not null")
    values = saved(classes.mapInPandas(_values(length, hashes), "value long, rid long, score long"))
    hubs = saved(values.groupBy("value").agg(F.min("rid").alias("least"), F.max("rid").alias("most"), F.max(F.struct("score", "rid")).alias("top"))
                 .where("least <> most").select("value", F.col("top.rid").alias("hub")))
    blob = classes.select("rid", "seq")
    other = classes.select(F.col("rid").alias("hub"), F.col("seq").alias("hub_seq"))
    links = f"a long, b long, in_a {_SPANS}, in_b {_SPANS}"

    def verified(pairs, enough=enough):
        both = pairs.join(blob, "rid").join(other, "hub").select("rid", "hub", "seq", "hub_seq")
        return saved(both.mapInPandas(_verify(length, percent, hashes, enough), links))

    explained = lambda x: x.select(F.col("a").alias("rid"), F.explode("in_a").alias("s")).union(
        x.select(F.col("b").alias("rid"), F.explode("in_b").alias("s"))).distinct()
    # a class of several equal regions is explained as a whole
    whole = regions.groupBy("rid").agg(F.count("*").alias("copies"), F.first("n").alias("n")).where("copies > 1")
    copies = whole.select("rid", F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("end")).alias("s"))

    def known(found):
        return explained(found).union(copies).groupBy("rid").agg(F.collect_list("s").alias("spans"))

    pairs = saved(_pairs(values.select("value", "rid"), hubs, enough))
    found = verified(pairs).union(saved(blob.mapInPandas(_within(length, percent), links)))
    # what the hub did not explain meets the hub of what is still left
    left = saved(classes.join(known(found), "rid", "left").select("rid", "seq", "spans").mapInPandas(_left_over(length, percent, hashes), "value long, rid long"))
    own = left.groupBy("value").agg(F.max(F.struct(F.xxhash64("rid", "value"), "rid"))["rid"].alias("hub"), F.min("rid").alias("least"), F.max("rid").alias("most")) \
        .where("least <> most").select("value", "hub")
    found = found.union(verified(_pairs(left, own, 1).join(pairs, ["rid", "hub"], "left_anti"), 0))
    # then every region that could hold a near duplicate of what is not explained, or link two classes
    roots = saved(connected_components(found.select("a", "b")).withColumnRenamed("node", "rid"))
    asks = saved(_asks(classes.join(known(found), "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")), length, percent)
                 .join(found.select(F.col("a").alias("rid"), F.col("b").alias("hub")), ["rid", "hub"], "left_anti"))
    one = asks.groupBy("least", "most").agg(F.max(F.struct("tokens", "rid", "hub")).alias("best"), F.max("open").alias("open"))
    first = saved(asks.where("open").select("rid", "hub").union(one.where("least <> most").select("best.rid", "best.hub")).distinct())
    more = verified(first, 0)
    roots = saved(_linked(roots, more))
    top = roots.select(F.col("rid").alias("least"), F.col("root").alias("a")), roots.select(F.col("rid").alias("most"), F.col("root").alias("b"))
    rest = asks.where("least <> most").join(first, ["rid", "hub"], "left_anti").join(top[0], "least", "left").join(top[1], "most", "left") \
        .where(F.coalesce("a", "least") != F.coalesce("b", "most")).select("rid", "hub")
    more = more.union(verified(rest, 0))
    found, roots = found.union(more), _linked(roots, more)

    spans = explained(found).union(copies).groupBy("rid").agg(F.expr(_MERGED).alias("spans"))
    placed = regions.select("id", "row", "start", "rid").join(spans, "rid").join(roots, "rid", "left") \
        .withColumn("root", F.coalesce("root", "rid"))
    firsts = placed.groupBy("root").agg(F.min("id").alias("class_id"), F.min(F.struct(F.coalesce("id", F.lit(1 << 62)), "row", "start")).alias("first"))
    marked = placed.join(firsts, "root").select("row", F.explode("spans").alias("s"), "start", "class_id",
                                                ((F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))).alias("first")) \
        .select("row", F.struct((F.col("start") + F.col("s.start")).cast("int").alias("start"), (F.col("start") + F.col("s.end") + SHINGLE - 1).cast("int").alias("end"),
                                "class_id", "first").alias("s")).groupBy("row").agg(F.collect_set("s").alias("spans"))
    out = rows.select("id", "row", "n_words").distinct().join(marked, "row", "left")
    return out.mapInPandas(_summed, f"id long, n_words long, n_repeated long, n_dropped long, class_ids array<long>, spans {_OUT}").withColumnRenamed("id", id_col)


_OUT = "array<struct<start:int,end:int,class_id:bigint,first:boolean>>"


def _summed(frames):
    for pdf in frames:
        out = []
        for r in pdf.itertuples(index=False):
            n = int(r.n_words)
            spans = [] if r.spans is None else sorted((s["start"], min(s["end"], n), s["class_id"], s["first"]) for s in r.spans)
            merged: list[list] = []
            for s, e, c, f in sorted(spans, key=lambda x: (str(x[2]), x[3], x[0])):
                if merged and merged[-1][2:] == [c, f] and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e, c, f])
            some, dropped = np.zeros(n, bool), np.zeros(n, bool)
            for s, e, _, f in merged:
                some[s:e] = True
                if not f:
                    dropped[s:e] = True
            out.append((r.id, n, int(some.sum()), int(dropped.sum()), sorted({m[2] for m in merged if m[2] is not None}),
                        [dict(zip(("start", "end", "class_id", "first"), m, strict=True)) for m in sorted(merged, key=lambda m: m[:2])]))
        frame = pd.DataFrame(out, columns=["id", "n_words", "n_repeated", "n_dropped", "class_ids", "spans"])
        yield frame.astype({"id": "Int64"})
