"""Plain versions of the operators over lists of rows, as slow and as simple as they can be."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

SPACES = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text):
    """(kind, start, end) by the four patterns."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def pii_digest(text):
    spans = base_spans(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (*(sum(x[0] == k for x in spans) for k in ("email", "ip", "card", "phone")), hashlib.sha256(joined.encode()).hexdigest())


def shingles(text, n=4):
    words = re.findall(SPACES, (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def ngram_links(rows, n=4, percent=85):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, n) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    group = components(sets, links)
    return {i: (len(s), group[i]) for i, s in sets.items()}


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=10):
    """doc_id -> (n_words, n_hit, n_items, digest, contaminated)."""
    wanted = {}
    for item, text in items:
        w = benchmark_words(text)
        for i in range(max(0, len(w) - size + 1)) if len(w) >= size else ([0] if w else []):
            wanted.setdefault(tuple(w[i:i + size]), set()).add(item)
    widths = {len(w) for w in wanted}
    out = {}
    for doc, text in docs:
        w, hit, found = benchmark_words(text), set(), set()
        for width in widths:
            for i in range(len(w) - width + 1):
                for item in wanted.get(tuple(w[i:i + width]), ()):
                    hit.update(range(i, i + width))
                    found.add(item)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


def check_packing(docs, pieces, tokenizer, end_id=2, longest=4096):
    """Every token in one piece, sequences gapless, crc right; returns the tokens of padding."""
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id] for d, t in docs}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        part = own[p["start"]:p["start"] + p["length"]]
        assert len(part) == p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    assert set(by_doc) == set(ids)
    for d, found in by_doc.items():
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[d])
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= longest
        padding += 0 if at & (at - 1) == 0 else longest - at
    return padding


def length_sums(lengths):
    """Rows as suffix_sums gives them."""
    out = []
    for n in sorted(set(lengths)):
        at_least = [x for x in lengths if x >= n]
        out.append((n, lengths.count(n), len(at_least), sum(at_least), len(lengths) - len(at_least),
                    sum(min(x, n) for x in lengths), len(lengths), sum(lengths)))
    return out


def repeated_spans(docs, length=50):
    """Rows of (doc_id, start, end, n_words, n_removable)."""
    words = {i: [(m[0], *m.span()) for m in re.finditer(SPACES, t or "")] for i, t in docs}
    places = {}
    for i in sorted(words):
        for s in range(len(words[i]) - length + 1):
            places.setdefault(tuple(w for w, _, _ in words[i][s:s + length]), []).append((i, s))
    covered, again = {}, {}
    for found in places.values():
        for n, (i, s) in enumerate(found if len(found) > 1 else []):
            covered.setdefault(i, set()).update(range(s, s + length))
            again.setdefault(i, set()).update(range(s, s + length) if n else [])
    out = []
    for i, at in covered.items():
        for s in sorted(x for x in at if x - 1 not in at):
            e = s
            while e in at:
                e += 1
            out.append((i, words[i][s][1], words[i][e - 1][2], e - s, len([x for x in again[i] if s <= x < e])))
    return sorted(out)


def gram_counts(text):
    """n-grams of one to three characters of the letters-only, lower-case text."""
    line, last = " ", True
    for c in text or "":
        if c.isalpha():
            line += c.lower() if len(c.lower()) == 1 else c
            last = False
        elif not last:
            line += " "
            last = True
    if not last:
        line += " "
    if line == " ":
        return Counter()
    out = Counter(c for c in line if c != " ")
    out.update(line[i:i + 2] for i in range(len(line) - 1))
    out.update(line[i:i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def ranked(counts, places=300):
    code = lambda g: tuple(map(ord, g))
    number = lambda g: sum(c << (21 * k) for k, c in enumerate(reversed(code(g))))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:places]


def language(text, profiles, places=300):
    """(language, score) by out-of-place distance to ranked lists by language."""
    own = ranked(gram_counts(text), places)
    if not own or not profiles:
        return "und", 0.0
    best = None
    for name in sorted(profiles):
        place = {g: r for r, g in enumerate(profiles[name])}
        distance = sum(abs(place[g] - r) if g in place else places for r, g in enumerate(own))
        if best is None or distance < best[0]:
            best = (distance, name)
    return best[1], 1 - best[0] / (len(own) * places)


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def licence_phrases(text, phrases):
    """n_words, n_base, first_word, last_word, base_labels."""
    own = licence_words(text)
    places = [(i, label) for label, phrase in phrases for i in range(len(own)) if own[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(own), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def short_places(text, templates, least):
    own = licence_words(text)
    for k, (_, phrase) in enumerate(templates):
        n = len(phrase.split())
        if 0 < n < least:
            yield from ((k, i) for i in range(len(own) - n + 1) if own[i:i + n] == phrase.split())


def common_runs(text, templates, least):
    """(template, start, start in the template, words) of the longest runs of equal words."""
    own = licence_words(text)
    for k, (_, phrase) in enumerate(templates):
        other = phrase.split()
        if len(other) < least:
            continue
        for i in range(len(own)):
            for j in range(len(other)):
                if own[i] == other[j] and (not i or not j or own[i - 1] != other[j - 1]):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if n >= least:
                        yield k, i, j, n


def best_chain(matches, gap):
    """Words of the best chain, trying every predecessor of every match."""
    matches, best = sorted(matches), []
    for i, (at, place, n) in enumerate(matches):
        most = n
        for j in range(i):
            shared = max(matches[j][0] + matches[j][2] - at, matches[j][1] + matches[j][2] - place, 0)
            if shared < n and matches[j][1] < place and at - matches[j][0] - matches[j][2] <= gap:
                most = max(most, best[j] + n - shared)
        best.append(most)
    return max(best)


def _nearest(point, centres):
    distances = [sum((a - b) ** 2 for a, b in zip(point, c, strict=True)) for c in centres]
    return min(range(len(centres)), key=lambda k: (distances[k], k)), min(distances)


def _floor_means(points, labels, before):
    out = []
    for k, old in enumerate(before):
        own = [p for p, x in zip(points, labels, strict=True) if x == k]
        out.append([sum(c) // len(own) for c in zip(*own, strict=True)] if own else old)
    return out


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    labels, errors, final = [], [0] * len(rows), []
    for p in range(parts):
        cut = [w[p * width:(p + 1) * width] for w in whole]
        book = cut[:entries]
        for _ in range(rounds):
            book = _floor_means(cut, [_nearest(c, book)[0] for c in cut], book)
        found = [_nearest(c, book) for c in cut]
        labels.append([k for k, _ in found])
        errors = [e + d for e, (_, d) in zip(errors, found, strict=True)]
        final += [x for entry in book for x in entry]
    digest = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{labels[p][k]:02x}" for p in range(parts)), errors[k], total[label], digest) for k, (i, _, label) in enumerate(rows)]


def first_hash(vec_id):
    return hashlib.sha256(f"3:{vec_id}".encode()).hexdigest()


def lloyd(rows, clusters=8, rounds=10):
    """rows: (vec_id, vector, label)."""
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows]
    centres = [v for _, v in sorted(whole, key=lambda r: (r[0] is None, first_hash(r[0]), r[1]))[:clusters]]
    points = [v for _, v in whole]
    for _ in range(rounds):
        centres = _floor_means(points, [_nearest(p, centres)[0] for p in points], centres)
    found = [_nearest(p, centres) for p in points]
    inertia = [sum(d for k, d in found if k == j) for j in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, k, d, inertia[k], sum(inertia), names[k]) for (i, _), (k, d) in zip(whole, found, strict=True)]
