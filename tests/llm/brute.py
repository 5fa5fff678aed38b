"""Plain Python versions of the operators' results, for small tables."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations


def words(text):
    return [] if text is None else text.encode().split()


def shingle_set(text, size=5):
    w = words(None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def components(rows, percent=80):
    """{doc_id: (set size, smallest linked id)} of (doc_id, text) rows."""
    sets = {d: shingle_set(t) for d, t in rows}
    by_set = defaultdict(list)
    for d, s in sets.items():
        if s:
            by_set[s].append(d)
    kinds = list(by_set)
    common = defaultdict(int)
    at = defaultdict(list)
    for i, s in enumerate(kinds):
        for x in s:
            at[x].append(i)
    for v in at.values():
        for a, b in combinations(v, 2):
            common[a, b] += 1
    root = list(range(len(kinds)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(kinds[a]) + len(kinds[b]) - n):
            root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, s in enumerate(kinds):
        least[find(i)] = min(x for x in [least[find(i)], *by_set[s]] if x is not None)
    out = {d: (0, d) for d, s in sets.items() if not s}
    for i, s in enumerate(kinds):
        out |= {d: (len(s), least[find(i)]) for d in by_set[s]}
    return out


def secret_base(text):
    """[(start, kind number, end, name, value)] of the base patterns, sorted."""
    import re
    kinds = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
             ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0)]
    out = []
    for k, (name, pattern, least, group) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name, m[group]) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def secret_extra(text):
    import re
    base = secret_base(text)
    found = [(m.start(), 3, m.end(), "owned", m[0]) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or "")
             if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    return [x for x in found if not any(x[0] < b[2] and b[0] < x[2] for b in base)]


def secrets(rows):
    """{id: (base, spans, live, copied)} of (id, text, owner, repo) rows with distinct ids."""
    per = {i: (secret_base(t), secret_extra(t), o or "", r or "") for i, t, o, r in rows}
    owners, repos = defaultdict(set), defaultdict(set)
    for base, extra, o, r in per.values():
        for s in base + extra:
            owners[s[4]].add(o)
            repos[s[4]].add((o, r))
    copied = {v for v in owners if len(owners[v]) >= 3 or len(repos[v]) >= 5}
    return {i: (base, sorted(base + [s for s in extra if s[4] not in copied]),
                sum(s[4] not in copied for s in base + extra), sum(s[4] in copied for s in base + extra)) for i, (base, extra, _, _) in per.items()}


def removed_bytes(rows, length=200):
    """{id: (bytes, removed, spans, kept bytes)} of (id, text) rows with distinct ids."""
    from collections import Counter
    data = {i: (t or "").encode() for i, t in rows}
    often = Counter(b[k:k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if often[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def repeated_windows(rows, n=50):
    """{id: set of word places in runs of ``n`` words that another text has too} of (id, text) rows with distinct ids."""
    at = defaultdict(set)
    data = {i: [w.lower() for w in words(t)] for i, t in rows}
    for i, w in data.items():
        for k in range(len(w) - n + 1):
            at[tuple(w[k:k + n])].add(i)
    return {i: {p for k in range(len(w) - n + 1) if len(at[tuple(w[k:k + n])]) > 1 for p in range(k, k + n)} for i, w in data.items()}


def quality_base(text):
    """(words, their code points, symbols, repeated lines, words in repeated 8-word windows)."""
    import re
    from collections import Counter
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {p for i, x in enumerate(windows) if often[x] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def word_edit_distance(item, text):
    """Least word edits between ``item`` and any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def url_verdict(url, rules):
    """(host, path, rule, verdict) by the host rules; the verdict is None where none fits."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]
