"""Brute-force versions that several tests use."""

import xxhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fps):
    """For each fingerprint the least index reachable over links, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def near_groups(rows):
    """doc_id -> least doc_id of its group, from (doc_id, text)."""
    rows = sorted(rows, key=lambda r: r[0])
    roots = components([slow_fingerprint(t) for _, t in rows])
    return {rows[k][0]: rows[r][0] for k, r in enumerate(roots)}
