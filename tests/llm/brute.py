"""Slow and plain versions of what the operators compute."""

import re

LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def shingle_set(text):
    w = words(text)
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def near(docs, percent=60):
    """{row: (n, links, component)} of rows (id, text)."""
    sets = [shingle_set(t) for _, t in docs]
    link = [[j for j in range(len(docs)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(len(docs))]
    out = []
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((docs[i][0], len(sets[i]), len(link[i]), min(docs[j][0] for j in seen)))
    return sorted(out)


def line_dedup(docs, percent=80):
    """{id: (removed lines, text)} of rows (id, text) with distinct ids."""
    seen, out = [], {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        if text is None:
            out[i] = ([], None)
            continue
        gone, kept = [], []
        for n, line in enumerate(text.split("\n")):
            w = frozenset(words(line))
            if w and any(100 * len(w & o) >= percent * len(w | o) for o in seen):
                gone.append(n)
            else:
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = (gone, "\n".join(kept))
    return out


def contaminated(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = alnum(text)
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for i, text in docs:
        w, found = alnum(text), set()
        hit = [0] * len(w)
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    found |= own
                    hit[k : k + m] = [1] * m
        out.append((i, len(w), sum(hit), sorted(found, key=lambda x: (x is None, x))))
    return out
