"""Plain-Python versions of the corpus operators, written from their contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def suffix_dedup(rows, length=50):
    first = {}
    for d, text in sorted(rows, key=lambda r: order(r[0])):
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i:i + length], d)
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if order(first[b[i:i + length]]) < order(d):
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return out


def substring_dedup(rows, length=35):
    seqs = [(d, words(t)) for d, t in rows]
    times = Counter(tuple(w[i:i + length]) for _d, w in seqs for i in range(len(w) - length + 1))
    out = []
    for d, w in seqs:
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if times[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def line_dedup(rows, min_lines, long_words=10):
    lines = [(d, (t or "").split("\n")) for d, t in rows]
    numbered = [(d, [(i, x) for i, x in enumerate(ls) if WORD.search(x)]) for d, ls in lines]
    first, texts = {}, {}
    for (d, t), (_d, ls) in sorted(zip(rows, numbered), key=lambda r: order(r[0][0])):
        texts.setdefault(t or "", order(d))
        for p in range(len(ls)):
            for n in {1, min_lines}:
                if p + n <= len(ls):
                    first.setdefault(tuple(x for _i, x in ls[p:p + n]), (order(d), p))
    out = []
    for (d, every), (_d, ls) in zip(lines, numbered):
        gone = {i for i, _x in ls} if texts["\n".join(every)] < order(d) else set()
        for p in range(len(ls)):
            for n in {1, min_lines}:
                run = tuple(x for _i, x in ls[p:p + n])
                if p + n <= len(ls) and (n == min_lines or len(words(run[0])) >= long_words) and first[run] < (order(d), p):
                    gone.update(i for i, _x in ls[p:p + n])
        out.append((d, len(ls), len(gone), sha("\n".join(x for i, x in enumerate(every) if i not in gone).encode())))
    return out


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_groups(rows):
    sets = [shingles(t) for _d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _t) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _t), s) in enumerate(zip(rows, sets))]


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if times[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


ALNUM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def leaks(docs, items, threshold=0.75):
    def grams(w):
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    out = {}
    for d, text in docs:
        w = ALNUM.findall(lower(text))
        for item, other in items:
            x = ALNUM.findall(lower(other))
            if not x or not w:
                continue
            mine = grams(x)
            best = 0.0
            for p in range(max(1, len(w) - len(x) + 1)):
                part = w[p:p + len(x)]
                if (len(part) < 5) != (len(x) < 5):
                    continue
                theirs = grams(part)
                low = sum((mine & theirs).values())
                best = max(best, low / (sum(mine.values()) + sum(theirs.values()) - low))
            if best >= threshold:
                out[(d, item)] = best
    return out
