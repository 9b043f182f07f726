"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(rows, benchmark):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in benchmark:
        w = split(text)
        for p in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[p : p + 13])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, items = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    items |= found
                    hit.update(range(p, p + n))
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


def near(rows):
    def shingles(text):
        w = WORD.findall(lower(text))
        if len(w) < 5:
            return {tuple(w)} if w else set()
        return {tuple(w[p : p + 5]) for p in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return [(i, len(sets[i]), label[i], label[i] == i) for i in sets]


def substrings(rows, window=50):
    split = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i, w in split.items():
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def exact(rows):
    plain = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in rows}
    groups = collections.defaultdict(list)
    for i, t in plain.items():
        groups[t].append(i)
    return [(i, min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in plain.items()]


def private(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in sorted(found))
