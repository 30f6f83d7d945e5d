"""Plain versions of the operators, over lists."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs):
    """{doc_id: (n_shingles, component)} for (doc_id, text) with distinct ids."""
    sets = {}
    for i, text in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        common.update((ids[a], ids[b]) for a in range(len(ids)) for b in range(a + 1, len(ids)))
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def repeated_words(docs, k=35):
    """[(n_words, n_removed, sha)] for texts, in their order."""
    words = [WORD.findall(t or "") for t in docs]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def line_dedup(docs, width=2):
    """{(doc_id, text): (n_lines, n_removed, kept)} for distinct (doc_id, text), in the operator's order of ids."""
    seen, out = {}, {}
    for key in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        text = key[1]
        if text is None:
            out[key] = (0, 0, None)
            continue
        lines = text.split("\n")
        trimmed = [x.strip("\x20\x09\x0a\x0b\x0c\x0d") for x in lines]
        full = [i for i, t in enumerate(trimmed) if t]
        gone = set()
        for j in range(len(full) - width + 1):
            run = tuple(trimmed[full[j + k]] for k in range(width))
            if run in seen:
                end = full[j + width] if j + width < len(full) else len(lines)
                gone.update(range(full[j], end))
            seen.setdefault(run, (key, j))
        out[key] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def trie(convs):
    """Rows of the prefix trie of {id: [(role, text)]}: id, depth, parent, members, children, leaves, saved, digest of the ends."""
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    sums, out = {}, []
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = (sum(sums[x][0] for x in kids[k]) or 1, own + sum(sums[x][1] for x in kids[k]))
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fill_in_middle(doc_id, text, rate=50):
    """(doc_id, n, form, prefix, middle, output)."""
    text = text or ""
    units, h = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    x, n = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)], len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or x[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((x[0] % (n + 1), x[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if x[3] % 100 < 80 else (doc_id, n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}")
