"""Plain Python versions of the dedup operators."""

from collections import defaultdict

import xxhash


def members(rows):
    """Row texts by id; a missing id is a document of its own, after the others."""
    return [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]


def brute_lines(rows):
    keys, owner = lambda t: [line.strip(b" \t\n\x0b\x0c\r").lower() for line in t.split(b"\n")], {}
    holders = defaultdict(set)
    for i, t in members(rows):
        for k in keys(t):
            if len(k.decode()) >= 10:
                holders[k].add(i)
    owner = {k: min(ids) for k, ids in holders.items() if len(ids) > 1}
    out = []
    for i, t in members(rows):
        left = [line for line, k in zip(t.split(b"\n"), keys(t)) if owner.get(k, i) == i]
        out.append((i, b"\n".join(left).decode(), t.count(b"\n") + 1, t.count(b"\n") + 1 - len(left)))
    return sorted(out)


def brute_substrings(rows):
    split = [(i, t.split()) for i, t in members(rows)]
    owner = {}
    for i, w in split:
        for k in range(len(w) - 12):
            window = tuple(w[k : k + 13])
            owner[window] = min(owner.get(window, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    return sorted(out)


def brute_fingerprint(text):
    words = text.lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(fps):
    """The least member of the class of each value that links reach; links are at most two bits."""
    fps, root = sorted(fps), {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}
