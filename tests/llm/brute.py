"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WS = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def op1(docs):
    groups = defaultdict(list)
    for d in docs:
        groups[WS.sub(" ", d["text"] or "")].append(d["doc_id"])
    return {d["doc_id"]: (min(g), len(g), d["doc_id"] == min(g), sha(k)) for d in docs for k in [WS.sub(" ", d["text"] or "")] for g in [groups[k]]}


def op2(docs, width=35):
    words = {d["doc_id"]: WORD.findall(d["text"] or "") for d in docs}
    seen = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[k] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def op6(docs, width=4, percent=80):
    sets = {}
    for d in docs:
        w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(d["text"] or "")]
        sets[d["doc_id"]] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            by[g].append(k)
    inter = Counter()
    for ks in by.values():
        ks = sorted(ks)
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                inter[a, b] += 1
    for (a, b), n in inter.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def op7_targets(docs, weights=(5, 2, 1), epochs=3):
    size = Counter()
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, clamped = {}, set()
    while True:
        left = sum(size.values()) - sum(epochs * size[s] for s in clamped)
        free = [s for s in names if s not in clamped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * size[s]}
        if not over:
            target = share | {s: float(epochs * size[s]) for s in clamped}
            return size, target
        clamped |= over


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def op9(docs):
    out = {}
    for d in docs:
        t = d["text"] or ""
        found = [
            [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12],
            [(m.start(), 1, m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 18],
            [(m.start(), 2, m.end()) for m in HEX.finditer(t) if len(m[0]) >= 16],
        ]
        spans = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(found, []))]
        out[d["doc_id"]] = (*map(len, found), sha(",".join(spans)), spans)
    return out


def token_ids(docs, path, end_id):
    """doc_id -> ids as little-endian bytes, by the library over whole texts."""
    import numpy as np
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path).encode_batch([d["text"] or "" for d in docs], add_special_tokens=False)
    return {d["doc_id"]: np.array([*f.ids, end_id], dtype="<u4") for d, f in zip(docs, found)}


def op10(docs, path):
    import zlib

    ids, start, out = token_ids(docs, path, 2), 0, {}
    for k in sorted(ids):
        out[k] = (start, len(ids[k]), zlib.crc32(ids[k].tobytes()))
        start += len(ids[k])
    return out


def check_op5(docs, pieces, path, context=1024):
    """Problems of a packing: pieces are rows with the contract's columns."""
    import zlib

    ids, bad = token_ids(docs, path, 0), []
    covered, used = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        if zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes()) != p["ids_crc32"] or p["doc_tokens"] != len(own):
            bad.append(("ids", p))
        covered[p["doc_id"]].append((p["start"], p["length"]))
        used[p["sequence_id"]].append((p["offset"], p["length"]))
    for name, spans, whole in [("doc", covered, lambda k, n: n == len(ids[k])), ("sequence", used, lambda k, n: n <= context)]:
        for k, s in spans.items():
            at = 0
            for begin, n in sorted(s):
                if begin != at or n < 1:
                    bad.append((name, k))
                at = begin + n
            if not whole(k, at):
                bad.append((name, k, at))
    if set(covered) != set(ids):
        bad.append("documents")
    lengths = [sum(n for _, n in s) for s in used.values()]
    return bad, sum(0 if n & (n - 1) == 0 else context - n for n in lengths) / max(1, sum(lengths))


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11(docs, least=10, documents=2):
    """By place in docs; documents are known by id and text, null ids come last, of one id the smaller digest first."""
    order = lambda d: (d["doc_id"] is None, d["doc_id"] or 0, hashlib.sha256((d["text"] or "").encode()).digest())
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UPPER)
    held = defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(order(d))
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < documents or order(d) == min(held[key(x)])]
        out.append((d["doc_id"], len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def op12(docs, least_docs=3, top=200):
    words = [(d["lang"] or "", d["source"] or "", [t.translate(UPPER) for t in TERM.findall(d["text"] or "")]) for d in docs]
    df, count, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, w in words:
        df.update((lang, t) for t in set(w))
        count[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), n in df.items() if g == lang and n >= least_docs)

        def weight(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: weight(count[lang, s]) for s in sources}
        q = weight(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(ranked) if part == "pair" or k < top]
    return out


def op13(rows, positives=5, negatives=10, scale=256, low=30, high=90):
    """rows: (id, label, vector). Counts rows of (anchor, positive, rank, negative, scores), as ids may repeat."""
    import math

    whole = []
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, label, [math.floor(scale * x) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for k, (i, label, v) in enumerate(whole):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, n) for n, (j, _, w) in enumerate(whole) if n != k)
        near = [(s, j) for s, j, n in scored if whole[n][1] == label][:positives]
        for s, j in near:
            far = [(t, m) for t, m, n in scored if whole[n][1] != label and low * -s <= 100 * -t <= high * -s][:negatives]
            for rank, (t, m) in enumerate(far):
                out[i, j, rank + 1, m, -s, -t] += 1
    return out
