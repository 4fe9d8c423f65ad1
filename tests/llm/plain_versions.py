"""The operators once more, in plain Python, for small inputs."""

import hashlib
import math
import re


def contamination(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict = {}
    for name, text in items:
        w = cut(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(name) if name is not None else "")
    out = []
    for text in texts:
        w, hit, found = cut(text), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= names
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def groups(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [(len(s), root(k)) for k, s in enumerate(sets)]


def targets(sizes, cycle=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: cycle[k % len(cycle)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def measures(text):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    lines, dups, seen = [x for x in text.split("\n") if x.encode().split()], 0, set()
    for line in lines:
        dups += line in seen
        seen.add(line)
    grams: dict = {}
    for k in range(len(words) - 4):
        grams.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + d for at in grams.values() if len(at) > 1 for k in at for d in range(5)}
    return [len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines), dups, len(repeated)]


def passes_quality(text):
    n_words, chars, symbols, lines, dups, repeated = measures(text)
    return not (
        n_words < 10 or 100 * repeated > 20 * n_words or symbols > 2 * n_words or chars < 2 * n_words or chars > 40 * n_words or (lines >= 5 and 100 * dups > 60 * lines)
    )


def mix(rows, block, golden, cycle=(5, 2, 1), epochs=3):
    """(taken, slots that take its first word, slots that take any of it) of each
    row (source, size, order key), by playing the schedule slot by slot."""
    sizes: dict = {}
    for source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
    target = targets(sizes, cycle)
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    take = {s: min(math.floor(target[s] + 0.5), epochs * sizes[s]) for s in names}
    blocks = {s: -(-sizes[s] // block) for s in names}
    slots = {s: take[s] // sizes[s] * blocks[s] + -(-(take[s] % sizes[s]) // block) if sizes[s] else 0 for s in names}
    low, total = {}, 0
    for s in names:
        low[s] = total
        total += slots[s]
    turn, plays = dict.fromkeys(names, 0), []
    for j in range(total):
        point = (j + 1) * golden
        at = min(math.floor((point - math.floor(point)) * total), total - 1)
        s = next(s for s in names if low[s] <= at < low[s] + slots[s])
        if turn[s] < slots[s]:
            plays.append((j, s, turn[s]))
        turn[s] += 1
    plays += [(total + low[s] + k, s, k) for s in names for k in range(turn[s], slots[s])]
    place, ends = {}, dict.fromkeys(names, 0)
    for k in sorted(range(len(rows)), key=lambda k: rows[k][2]):
        source, size, _ = rows[k]
        place[k] = ends[source]
        ends[source] += size
    taken, copies, any_of = [0] * len(rows), [[] for _ in rows], [[] for _ in rows]
    left = dict(take)
    for slot, s, k in sorted(plays):
        begin = k % blocks[s] * block
        words = min(block, sizes[s] - begin, left[s])
        left[s] -= words
        for r, (source, size, _) in enumerate(rows):
            both = min(place[r] + size, begin + words) - max(place[r], begin)
            if source == s and size and both > 0:
                taken[r] += both
                any_of[r].append(slot)
                if begin <= place[r]:
                    copies[r].append(slot)
    return [(t, c, len(a)) for t, c, a in zip(taken, copies, any_of)]
