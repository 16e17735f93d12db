"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_duplicates(rows, percent=85):
    """(doc_id, size, smallest reachable id) for rows of ids and texts."""
    sets = [shingles(t) for _, t in rows]
    holders: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common: dict = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                if rows[a][0] > rows[b][0]:
                    a, b = b, a
                parent[b] = a
    return sorted((rows[i][0], len(sets[i]), rows[root(i)][0]) for i in range(len(rows)))


def removed_repeats(rows, length=50):
    """(doc_id, bytes, removed, spans, kept) for rows of ids and texts; ids are different."""
    first: dict = {}
    out = []
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        mine = {raw[s : s + length] for s in range(len(raw) - length + 1)}
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in first:
                gone[s : s + length] = b"\1" * length
        for w in mine:
            first.setdefault(w, i)
        spans = sum(1 for p in range(len(raw)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def backoff_scores(rows, order=3, backoff=0.4):
    """(doc_id, words, log score) for rows of ids and texts."""
    from collections import Counter
    from math import log

    def grams(words):
        return Counter(tuple(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1))

    split = [(i, (t or "").encode().lower().split()) for i, t in rows]
    whole, total = Counter(), sum(len(w) for _, w in split)
    for _, words in split:
        whole.update(grams(words))
    out = []
    for i, words in split:
        own, score = grams(words), 0.0
        for at in range(len(words)):
            factor = 1.0
            for n in range(min(order, at + 1), 0, -1):
                gram = tuple(words[at - n + 1 : at + 1])
                seen = whole[gram] - own[gram]
                if seen > 0:
                    below = whole[gram[:-1]] - own[gram[:-1]] if n > 1 else max(total - len(words), 1)
                    score += log(factor * seen / below)
                    break
                factor *= backoff
            else:
                score += log(factor / max(total - len(words), 1))
        out.append((i, len(words), score))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) for rows of id, source, lang, n_chars and text."""

    def field(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    def leaf(row, more=0):
        i, source, lang, n, text = row
        return sha("".join(map(field, (i, source, lang, n if n is None else n + more, text))))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
        return levels

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for number, group in enumerate(groups):
        for place, row in enumerate(group):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, beside = leaf(row, int(tampered)), ""
            for levels, at in ((trees[number], place), (top, number)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    beside += other
                    node = sha(other + node if at % 2 else node + other)
                    at //= 2
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[number][-1][0], root, sha(beside), node, node == root))
    return out


def prefix_trie(rows, shared=8, every=5):
    """One tuple for each different beginning of the rebuilt conversations, for rows of id, turn, role and text."""

    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]

    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(turns)] for c, turns in own.items()}
    members: dict = {}
    ends: dict = {}
    for c, turns in own.items():
        giver = abs(c) // every * every * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % (shared + 1)
        turns = tuple(own.get(giver, [])[:h] + turns[h:])
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children: dict = {p: 0 for p in members}
    leaves = dict(children)
    saved = dict(children)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in members.items()
    ]
