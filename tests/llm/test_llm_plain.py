"""Plain versions that several tests hold operators against, and a check of the plain versions themselves."""

import re
from collections import defaultdict

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """(start, kind, end) of fixed personal data."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def components_of(texts, n, percent):
    """Connected components of links between texts (id: text)."""
    sets = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = list(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = defaultdict(set)
    for d in ids:
        out[find(d)].add(d)
    return list(out.values())


def plain_mix(rows):
    """Sizes and targets of the sources of rows (doc_id, source, words)."""
    sizes = defaultdict(int)
    for _, source, n in rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = min(share[s], 2.0 * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return sizes, target


def test_plain_versions():
    assert components_of({1: "a b c", 2: "A b c", 3: "x", 4: ""}, 2, 100) == [{1, 2}, {3}, {4}]
    assert plain_mix([(1, "a", 10), (2, "b", 90)])[1] == {"a": 20.0, "b": 130.0}
    assert [s[1] for s in base("x@y.z 1.2.3.4")] == [0, 1]
