"""Plain Python versions of the operators, from their contracts."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

BREAKS = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in BREAKS.split((text or "").encode()) if w]


def lower_words(text):
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(own):
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())


def components(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(lower_words(t)) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    lowest = {}
    for (doc_id, _), x in zip(rows, label):
        if doc_id is not None:
            lowest[x] = min(lowest.get(x, doc_id), doc_id)
    return sorted(
        ((d, len(s), lowest.get(x) if s else d) for (d, _), s, x in zip(rows, sets, label)), key=str
    )


def quality_counts(text):
    text = text or ""
    own = words(text)
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if words(line)]
    dups = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(own), sum(len(w.decode()) for w in own), sum(text.count(c) for c in "#*$%&|<>"), dups, len(marked)


def without_repeats(rows, width=50):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first, out = {}, []
    for doc_id, text in rows:
        own = words(text)
        for i in range(len(own) - width + 1):
            key = tuple(own[i : i + width])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - width + 1):
            if doc_id is not None and first[tuple(own[i : i + width])] < doc_id:
                gone[i : i + width] = [True] * width
        kept = [w for w, g in zip(own, gone) if not g]
        out.append((doc_id, len(own), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def held_items(docs, items):
    """(doc_id, item_id, item shingles, shared) by comparing every item with every document."""
    out = []
    for doc_id, text in docs:
        own = lower_words(text)
        for item_id, item in sorted(set(items), key=str):
            wanted = lower_words(item)
            width = min(5, len(wanted))
            if not wanted:
                continue
            whole = {tuple(wanted[i : i + width]) for i in range(len(wanted) - width + 1)}
            shared = len(whole & {tuple(own[i : i + width]) for i in range(len(own) - width + 1)})
            if 100 * shared >= 75 * len(whole):
                out.append((doc_id, item_id, len(whole), shared))
    return sorted(out, key=str)


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def url_verdict(url, rules, default="allow"):
    host, path = url_parts(url)
    fits = [
        (len(h) + len(p), len(h), v, h + p)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, best[3], best[2]) if best else (host, path, None, default)


def license_words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def license_base(text, phrases):
    own = license_words(text)
    places = [
        (i, label)
        for label, phrase in phrases
        for i in range(len(own))
        if own[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(own), len(places), min(starts, default=None), max(starts, default=None), labels


def prefix_trie(rows):
    """The trie of the rebuilt conversations, from (conv_id, turn, role, text) rows without equal turns."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    nodes = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        whole = tuple(own.get(conv - math.fmod(conv, 5), [])[:h] + own[conv][h:])
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append((conv, len(whole)))
    below = {}
    for path in nodes:
        for d in range(len(path) + 1):
            below.setdefault(path[:d], []).append(path)
    out = []
    for path, members in nodes.items():
        children = [p for p in below[path] if len(p) == len(path) + 1]
        leaves = sum(all(len(q) <= len(p) for q in below[p]) for p in below[path])
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below[path] if p)
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(path))))
        parent = min(nodes[path[:-1]])[0] if path else None
        out.append((min(members)[0], len(path), parent, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out
