"""Plain versions of the operators for small tables, and fixtures with the cases every operator must define."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, th int, rank double, text_ string, hits array<int>, node long, _doc long, score double"
EXTRA = [7, "x", 1, 0.5, "y", [1], 3, 4, 0.25]  # columns whose names the operators use themselves


def docs(spark, rows):
    """Documents of (doc_id, text[, lang, source]) with clashing extra columns."""
    full = []
    for r in rows:
        doc_id, text, lang, source = [*r, "en", "src0"][:4] if len(r) < 4 else r
        full.append((doc_id, text, lang, source, None if text is None else len(text), *EXTRA))
    return spark.createDataFrame(full, DOCS)


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent=85):
    """(doc_id, n_shingles, component) of rows with distinct ids, all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeats(rows, k=13):
    """(n_words, n_removed, kept_sha256) per row, for rows of (doc_id, text)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {x for j in range(len(w) - k + 1) if first[tuple(w[j:j + k])] < i for x in range(j, j + k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha256(" ".join(kept).encode()).hexdigest()))
    return out


def targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), most=2):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = share * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        total = sum(weight[s] for s in open_)
        now = {s: rest * weight[s] / total for s in open_}
        above = [s for s in open_ if now[s] > most * sizes[s]]
        if not above:
            return {s: float(fixed.get(s, now.get(s))) for s in names}
        fixed.update({s: Fraction(most * sizes[s]) for s in above})


def base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def damage(rows):
    """Conversations of (conv_id, turn, role, text) after the planted faults, by conv_id."""
    out = {}
    for conv, turn, role, text in rows:
        k = crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        own = out.setdefault(conv, [])
        role, text = ("user" if k == 4 else " " if role is None else role), " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def repair(rows):
    """Counts, cheapest cost, audit and digest of a conversation of (turn, role, text): the best (cost, audit) of every state after every row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    after, name = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def relax(states, k, v):
        if k not in states or v[:2] < states[k][:2]:
            states[k] = v

    def inserted(states):
        for _ in range(4):
            for k, (c, a, o) in list(states.items()):
                relax(states, after[k], (c + 2, a + "I", (*o, (name[after[k]], ""))))
        return states

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for k, (c, a, o) in inserted(best).items():
            relax(new, k, (c + 3, a + "D", o))
            if fault not in ("blank", "duplicate"):
                c += fault == "truncated"
                if role[:1] == after[k] or (k == "" and role[:1] == "s"):
                    relax(new, role[:1], (c, a + "K", (*o, (role, text))))
                relax(new, after[k], (c + 2, a + "R", (*o, (name[after[k]], text))))
        best = new
    cost, audit, out = min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def runs(w):
    """(start, length, period) of the runs of a list of words, every lag over all words."""
    seen = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                seen.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def run_digest(doc_id, text):
    """The row of the runs query for a document."""
    w = words(text)
    n, h = len(w), 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), s, m, q, None if s is None else 1000 * m // q, sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
            sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
