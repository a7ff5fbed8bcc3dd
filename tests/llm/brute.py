"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def decontaminate(docs, items, window=10):
    """docs: [(doc_id, text)], items: [(item_id, text)] -> sorted rows of op2."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """sizes: {source: words} -> {source: target}, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return full | {s: left * weight[s] / total for s in free}
        for s in over:
            full[s] = cap * sizes[s]
        left = share * sum(sizes.values()) - sum(full.values())


def base_spans(text):
    """[(start, k, kind, end, value)] of op8's base."""
    text = text or ""
    kinds = [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted(
        (m.start(), k, kind, m.end(), m[2] if kind == "assign" else m[0])
        for k, (kind, pattern, keep) in enumerate(kinds)
        for m in re.finditer(pattern, text)
        if keep(m)
    )


def secrets(docs):
    """docs: [(doc_id, text, owner)] -> sorted (doc_id, base spans joined, all spans joined)."""
    owners: dict[str, set] = {}
    repositories: dict[str, set] = {}
    for doc, text, owner in docs:
        for s in base_spans(text):
            owners.setdefault(s[4], set()).add(owner)
            repositories.setdefault(s[4], set()).add(doc)
    out = []
    for doc, text, _ in docs:
        base = base_spans(text)
        live = {(s[3] - len(s[4]), 3, "live", s[3]) for s in base if len(owners[s[4]]) == 1 and len(repositories[s[4]]) <= 5}
        joined = lambda spans: ",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in sorted(spans))
        out.append((doc, joined(base), joined({s[:4] for s in base} | live)))
    return sorted(out, key=str)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))


def fingerprint(text):
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    n = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs, radius=2):
    """docs: [(doc_id, text)] -> sorted (doc_id, fingerprint, component_id)."""
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, f"{prints[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(docs)), key=str)


def substrings(docs, threshold=100):
    """docs: [(doc_id, text)], in order -> (doc_id, n_bytes, n_removed, n_spans, sha of the rest)."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - threshold + 1):
            s = data[i : i + threshold]
            if s in seen:
                gone[i : i + threshold] = b"\x01" * threshold
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc, len(data), sum(gone), spans, sha(kept)))
    return sorted(out, key=str)


def spark_hash(*values):
    """xxhash64 of several columns: whole numbers as int, or as (number, "q") for long; texts as str; null passes."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is None or v == (None, "q"):
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def mix(docs, seed=20240607, slopes=(0.5, 0.0, -0.5)):
    """docs: [(doc_id, text, source)] -> sorted (doc_id, size, taken, position, position_again), positions rounded."""
    import collections
    import math

    order = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    sizes = collections.Counter({s: 0 for s in order})
    lines, copies = {s: [] for s in order}, collections.Counter()
    for doc, text, source in docs:
        n = len(words_of(text))
        sizes[source] += n
        copies[doc, text, source] += 1
        low = spark_hash(seed, (doc, "q"), text)
        key = spark_hash(seed, (low, "q"), (copies[doc, text, source], "q"))
        lines[source].append((key % (1 << 64), low, doc is not None, doc or 0, n))
    aims, out = targets(sizes), []
    for k, source in enumerate(order):
        slope, aim, at = slopes[k % len(slopes)], aims[source], 0

        def time(place, slope=slope, aim=aim):
            share = min(1.0, place / aim)
            return round(share if slope == 0 else (1 + slope - math.sqrt(max(0.0, (1 + slope) ** 2 - 4 * slope * share))) / (2 * slope), 9)

        for _, _, known, doc, n in sorted(lines[source]):
            first = max(0, min(n, math.floor(aim) - at))
            second = max(0, min(n, math.floor(aim) - sizes[source] - at))
            out.append((doc if known else None, n, first + second, time(at) if first else None, time(at + sizes[source]) if second else None))
            at += n
    return sorted(out, key=str)


def units(text):
    """[(kind, start, end, normal text)] of op9: paragraphs, lines, and sentences inside lines."""
    out, at, paragraph = [], 0, []
    plain = lambda x: " ".join(x.lower().split())

    def trimmed(start, end):
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        return start, end

    def close():
        if paragraph:
            out.append(("paragraph", paragraph[0][0], paragraph[-1][1], " ".join(plain(text[s:e]) for s, e in paragraph)))
            paragraph.clear()

    text = text or ""
    for line in text.split("\n"):
        start, end = trimmed(at, at + len(line))
        if start == end:
            close()
        else:
            paragraph.append((start, end))
            out.append(("line", start, end, plain(text[start:end])))
            sentences, begun = [], at
            for k in range(at, at + len(line)):
                if text[k] in ".!?" and (k + 1 == at + len(line) or text[k + 1].isspace()):
                    # A mark alone doesn't open a sentence and close it at once.
                    if text[begun:k]:
                        sentences.append(trimmed(begun, k + 1))
                        begun = k + 1
            sentences.append(trimmed(begun, at + len(line)))
            sentences = [(s, e) for s, e in sentences if s < e]
            run = []

            def put(parts):
                joined = " ".join(plain(text[s:e]) for s, e in parts)
                if len(joined.split()) >= 6 and len(joined) >= 40:
                    out.append(("sentence", parts[0][0], parts[-1][1], joined))
                    return True
                return False

            for part in sentences:
                words = plain(text[part[0] : part[1]])
                if len(words.split()) >= 6 and len(words) >= 40:
                    put(run)
                    put([part])
                    run = []
                else:
                    run.append(part)
            put(run)
        at += len(line) + 1
    close()
    return out


def repeated_units(docs):
    """docs: [(doc_id, text)] of distinct ids -> sorted (doc_id, kind, start, end, first_doc_id, first_start)."""
    first, gone = {}, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        mine = []
        for kind, start, end, plain in sorted(units(text), key=lambda u: u[1]):
            at = first.setdefault((kind, plain), (doc, start))
            if at != (doc, start):
                mine.append((doc, kind, start, end, *at))
        size = {"paragraph": 0, "line": 1, "sentence": 2}
        for u in mine:
            inside = [v for v in mine if v is not u and v[2] <= u[2] and u[3] <= v[3] and ((v[2], v[3]) != (u[2], u[3]) or size[v[1]] < size[u[1]])]
            if not inside:
                gone.append(u)
    return sorted(gone, key=str)
