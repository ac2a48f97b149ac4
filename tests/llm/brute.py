"""Plain versions of the operators, for small tables."""
from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {i for k in range(len(words) - 7) if windows[tuple(words[k:k + 8])] > 1 for i in range(k, k + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(words) < 20 or 100 * len(covered) > 30 * len(words))


def shingles(text, size):
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + size]) for k in range(len(words) - size + 1))


class Groups:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near(rows, size, percent):
    """{id: smallest id of its component}."""
    sets = {i: shingles(t, size) for i, t in rows}
    groups = Groups(sets)
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = collections.Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            groups.join(a, b)
    return {i: groups.find(i) for i in sets}


def within(a, b, edits):
    """Whether the edit distance is at most ``edits`` (a plain table)."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= edits


def line_duplicates(rows, edits, short):
    """{(id, line number): place of the line that stays}."""
    places = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
    distinct = sorted({x for *_, x in places})
    groups = Groups(distinct)
    long = [x for x in distinct if len(x) >= short]
    for k, a in enumerate(long):
        for b in long[:k]:
            if abs(len(a) - len(b)) <= edits and sum((collections.Counter(a) - collections.Counter(b)).values()) <= edits and within(a, b, edits):
                groups.join(a, b)
    first = {}
    for i, k, x in sorted(places):
        first.setdefault(groups.find(x), (i, k))
    return {(i, k): first[groups.find(x)] for i, k, x in places if first[groups.find(x)] != (i, k)}


def targets(sizes, most=3):
    """{source: (size, target)}; None is last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, total, target, free = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()), {}, set(order)
    while free:
        rest = total - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > most * sizes[s]]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        free -= set(over)
    return target


def personal(text):
    """[(kind, start, end)] by kind, then place."""
    text, found = text or "", []
    digits = lambda m: re.sub(r"\D", "", m[0])
    luhn = lambda d: sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0
    for kind, pattern, valid in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
                                 ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
                                 ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
                                 ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if valid(m)]
    return found
