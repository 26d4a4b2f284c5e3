"""Plain-Python versions of the contracts, for comparison."""

import base64
import hashlib
import re
import zlib


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return lower(host), re.match("[^?#]*", rest[len(host) :])[0]


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(texts):
    """doc id -> (set size, smallest id reachable), by all pairs of sets."""
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_token = {}
    for d, s in sets.items():
        for x in s:
            by_token.setdefault(x, []).append(d)
    pairs = {(a, b) for ds in by_token.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def passages(text, items):
    """(n_words, n_hit, items) of one document."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(pattern, lower(text))
    hit, found = set(), set()
    for item, body in items:
        own = re.findall(pattern, lower(body))
        n = min(13, len(own))
        if not n:
            continue
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= {*range(i, i + n)}
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def b32_sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def phrases(rows, longest=4, least=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = {}, {}
    for lang, text in rows:
        f = counts.setdefault(lang or "und" if lang is None else lang, {})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            key = "und" if lang is None else lang
            totals[key] = totals.get(key, 0) + len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    g = tuple(words[i : i + n])
                    f[g] = f.get(g, 0) + 1
    out = []
    for lang, f in counts.items():
        own = []
        frequent = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        for g, a in frequent.items():
            longer = [b for h, b in frequent.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            own.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1)]
    return out


def audit(rows, least=30, top=50):
    """(lang, source, part, item, value, rank) of (lang, source, text) rows."""
    docs, counts, groups = {}, {}, set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        for w in words:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
        for w in set(words):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: [counts.get((lang, s, w), 0) for w in kept] for s in sources}
        whole = [sum(count[s][i] for s in sources) for i in range(len(kept))]
        p = {s: [1 + 1000000000 * (c + 5) // (sum(count[s]) + 5 * len(kept)) for c in count[s]] for s in sources}
        q = [1 + 1000000000 * (c + 5) // (sum(whole) + 5 * len(kept)) for c in whole]
        for s in sources:
            pairs = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[t], strict=True)), t.encode()) for t in sources if t != s)
            out += [(lang, s, "pair", t.decode(), -v, i) for i, (v, t) in enumerate(pairs, 1)]
            terms = sorted((b - a, w.encode()) for a, b, c, w in zip(p[s], q, count[s], kept, strict=True) if c and a > b)
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(terms[:top], 1)]
    return out


def longest_first(sizes, shards):
    """Loads of the shards when the largest goes to the least loaded, again and again."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return sorted(loads)
