"""Plain Python restatements that the small tests hold the operators against."""

from __future__ import annotations


def drop_repeated_lines(docs, min_words=51):
    """``docs``: (id, text) in id order, ids unique. Returns ``{id: text}``."""
    seen, gone = {}, {i: set() for i, _ in docs}
    chunks = []
    for i, text in docs:
        lines = text.split("\n")
        full = [p for p, line in enumerate(lines) if line.split()]
        size = {p: len(lines[p].split()) for p in full}
        spans = set()
        for a in range(len(full)):
            n = 0
            for b in range(a, len(full)):
                n += size[full[b]]
                if n >= min_words:
                    spans.add((a, b))
                    break
            n = 0
            for b in range(a, -1, -1):
                n += size[full[b]]
                if n >= min_words:
                    spans.add((b, a))
                    break
        for a, b in sorted(spans):
            chunks.append((i, full[a], full[b], tuple(lines[p] for p in full[a:b + 1])))
    for i, a, _, c in chunks:
        seen[c] = min(seen.get(c, (i, a)), (i, a))
    for i, a, b, c in chunks:
        if seen[c] != (i, a):
            gone[i].update(range(a, b + 1))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in docs}


def tag_path_text(tree, blocks, spread=0.5):
    """The text of parsed blocks by the definitions of ratios, smoothing, fusion, spreading and threshold."""
    import math
    if not blocks:
        return ""

    def chain(e):
        out = []
        while e >= 0:
            out.append(e)
            e = tree.parent[e]
        return out  # the element first, the root last

    paths = ["/".join(tree.names[e] for e in reversed(chain(e))) for e, _ in blocks]
    texts = [t for _, t in blocks]

    def mean(k, value):
        same = [value(t) for p, t in zip(paths, texts) if p == paths[k]]
        return sum(same) / len(same)

    def smooth(values):
        at = lambda k: values[min(max(k, 0), len(values) - 1)]
        return [at(k - 1) / 4 + at(k) / 2 + at(k + 1) / 4 for k in range(len(values))]

    long = smooth([mean(k, len) for k in range(len(texts))])
    marks = smooth([mean(k, lambda t: sum(t.count(c) for c in ".,;:!?\u3002\uff0c\uff1b\uff1a\uff01\uff1f\u3001")) for k in range(len(texts))])
    ratio = [a * math.log(b + 2) for a, b in zip(long, marks)]
    factor = [tree.fixed[e] * tree.words[e] * (4 if tree.inside[e] else 1) for e, _ in blocks]

    def inner(x):
        held = [k for k, (e, _) in enumerate(blocks) if x in chain(e)]
        size = sum(factor[k] * len(texts[k]) for k in held)
        return sum(factor[k] * len(texts[k]) * ratio[k] for k in held) / size if size else 0

    def handed(x):
        return inner(x) if x == 0 else max(inner(x), tree.step[x] * handed(tree.parent[x]))

    weight = [f * max(r, handed(e)) for f, r, (e, _) in zip(factor, ratio, blocks)]
    own = lambda v: sum(x * x * len(t) for x, t in zip(v, texts)) / sum(x * len(t) for x, t in zip(v, texts))
    least = spread * max(own(weight), 0.1 * own(ratio))
    return "\n".join(t for t, w in zip(texts, weight) if w > least or abs(w - least) < 1e-9 * least)


def simhash(text):
    """3-word SimHash by the definition, bit by bit."""
    import xxhash
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=2):
    """``{id: smallest reachable id}`` for ``{id: fingerprint}`` by comparing all pairs."""
    import numpy as np
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], dtype=np.uint64)
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for a in range(len(ids)):
        for b in np.nonzero(np.bitwise_count(x[a + 1:] ^ x[a]) <= radius)[0]:
            ra, rb = find(a), find(a + 1 + int(b))
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    return {i: ids[find(k)] for k, i in enumerate(ids)}
