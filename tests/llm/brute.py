"""Plain versions of the contracts, row by row, to hold the operators against."""

import hashlib
import re
import zlib

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
    return tuple(sum(k == kind for *_, k in found) for kind in ("assign", "access", "hex")) + (hashlib.sha256(joined.encode()).hexdigest(), joined)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = BLANK.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """doc_id to (set size, smallest doc_id reachable)."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def quality(text):
    text = text or ""
    w = BLANK.findall(text)
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def diagonals(text, templates, k=3, cover=0.6, short=16, grams=6, reach=4):
    """The spans (template, start, end, share) of the diagonal vote, row by row; alignments wider than a template are not cut."""
    words_of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, out = words_of(text), set()
    for name, template in templates.items():
        t = words_of(template)
        where = {}
        for j in range(len(t) - k + 1):
            where.setdefault(tuple(t[j : j + k]), []).append(j)
        found = sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in where.get(tuple(w[i : i + k]), ()))
        runs = []
        for d, i, j in found:
            if not runs or d - runs[-1][0] > reach:
                runs.append([d, []])
            runs[-1][0] = d
            runs[-1][1].append((i, j))
        for _, run in runs:
            last, covered, n, start, end = -k, set(), 0, None, None
            for i, j in sorted(run):
                if j > last:
                    last, n, end = j, n + 1, i + k
                    start = i if start is None else start
                    covered |= set(range(j, j + k))
            share = len(covered) / len(t)
            if (share >= 1 if len(t) <= short else share >= cover and n >= grams) and end - start <= 2 * len(t):
                out.add((name, start, end, share, len(covered)))
    return sorted(x[:4] for x in out if all((y[4], y[3]) <= (x[4], x[3]) for y in out if abs(x[1] - y[1]) <= 2 * reach))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def damage(rows):
    """(conv, turn, role, text) after the faults that the hash of conv:turn says."""
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def repaired(rows):
    """Conversation to (gaps, blank, duplicate, truncated, illegal, cost, audit, hash), by every state's best way to the end."""
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    by = {}
    for row in damage(rows):
        by.setdefault(row[0], []).append(row[1:])
    after, may = {"": "u", "s": "u", "u": "a", "a": "u"}, {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for q, n in after.items():
                if n in best:
                    cost, audit, lines = best[n]
                    best[q] = min(best.get(q, (10**9,)), (cost + 3, "I" + audit, [f"{full[n]}:", *lines]))
        return best

    for c, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
        seen, fault = set(), []
        for _, r, x in own:
            chars = BLANK.findall(x)
            fault.append("blank" if not chars else "duplicate" if (r, x) in seen else "truncated" if chars[-1][-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, *_ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        best = inserted({"": (0, "", []), "a": (0, "", [])})
        for (_, r, x), f in zip(reversed(own), reversed(fault), strict=True):
            new = {}
            for q in after:
                ways = []
                if q in best:
                    ways.append((best[q][0] + 4, "D" + best[q][1], best[q][2]))
                if f in ("", "truncated"):
                    more = 3 * (f == "truncated")
                    for letter, to, cost, role in [("K", r[:1], more, r)] * (r[:1] != "" and r[:1] in may[q]) + [("R", after[q], 3 + more, full[after[q]])]:
                        if to in best:
                            ways.append((best[to][0] + cost, letter + best[to][1], [f"{role}:{x}", *best[to][2]]))
                if ways:
                    new[q] = min(ways)
            best = inserted(new)
        cost, audit, lines = best[""]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def hashes(text):
    """The hashes of a text's shingles, in order."""
    return sorted({hashlib.md5(" ".join(s).encode()).hexdigest()[:12] for s in shingles(text)})


def sketched(text):
    h = hashes(text)
    low = [x for x in h if x < "2"]
    return low if len(low) >= 64 else h[:64]


def lloyd(x, rounds=4, entries=256):
    """Codes (one row a part position), codebooks and errors of whole-number vectors in order of their ids."""
    x = x.reshape(len(x), 4, -1)
    books = [[list(map(int, v)) for v in x[:entries, p]] for p in range(4)]

    def nearest(p, v):
        return min(range(len(books[p])), key=lambda e: (sum((int(a) - b) ** 2 for a, b in zip(v, books[p][e], strict=True)), e))

    for n in range(rounds + 1):
        codes = [[nearest(p, v) for v in x[:, p]] for p in range(4)]
        for p in range(4 if n < rounds else 0):
            for e in set(codes[p]):
                own = [list(map(int, v)) for v, c in zip(x[:, p], codes[p], strict=True) if c == e]
                books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    errors = [sum((int(a) - b) ** 2 for p in range(4) for a, b in zip(x[i, p], books[p][codes[p][i]], strict=True)) for i in range(len(x))]
    return codes, books, errors
