"""Plain Python versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import regex
import zstandard

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def kept_lines(rows, min_documents=10, copies_count=True, groups=None):
    """(n_lines, n_dropped, kept) of each (doc_id, text); ids of one group in ``groups`` count once."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    lines = [(t or "").split("\n") for _, t in rows]
    if copies_count:
        owners = [("id", i) if i is not None else ("text", t or "") for i, t in rows]
    else:
        owners = [frozenset(key(line) for line in own) - {""} for own in lines]
    owners = [("group", groups[i]) if groups and i in groups else o for (i, _), o in zip(rows, owners)]
    found = Counter(k for _, k in {(o, key(line)) for o, own in zip(owners, lines) for line in own} if k)
    out = []
    for own in lines:
        keep = [line for line in own if not key(line) or found[key(line)] < min_documents]
        out.append((len(own), len(own) - len(keep), "\n".join(keep)))
    return out


def spans(text, items, window=10):
    """(words, covered word positions, sorted items found) of a text, for items {id: text}."""
    own, hit, found = words(text), set(), set()
    for item, phrase in items.items():
        w = words(phrase)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            p = w[a : a + window]
            for at in range(len(own) - len(p) + 1):
                if own[at : at + len(p)] == p:
                    hit |= set(range(at, at + len(p)))
                    found.add(str(item))
    return own, hit, sorted(found)


def language(text, dictionaries):
    """(language, margin) by the sizes of the text's letter words, 1 KB by 1 KB and 64 blanks after each, under each dictionary."""
    letters = regex.findall(r"\p{L}+", (text or "").lower())
    if not letters:
        return "und", 0.0
    raw, sizes = f" {' '.join(letters)} ".encode(), []
    for name, content in dictionaries.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coder = zstandard.ZstdCompressor(level=6, dict_data=own, write_content_size=False, write_dict_id=False)
        sizes.append((sum(len(coder.compress(raw[i : i + 1024] + b" " * 64)) for i in range(0, len(raw), 1024)), name))
    (best, name), *rest = sorted(sizes)
    return name, (rest[0][0] - best) / best if rest else 1.0


def cut(text, hit):
    """The text without its runs of covered words."""
    at, out, places = 0, [], [m.span() for m in WORD.finditer((text or "").translate(LOWER))]
    for i, (_, end) in enumerate(places):
        if i in hit:
            if i - 1 not in hit:
                out.append(text[at : places[i][0]])
            at = end
    return "".join([*out, text[at:]])


def grams(text, n=5):
    w = words(text)
    k = min(n, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()


def linked(texts, threshold=0.8):
    """Links {id: count} and groups {id: least id} of texts {id: text}."""
    sets, links, root = {i: grams(t) for i, t in texts.items()}, Counter(), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both >= threshold * (len(sets[i]) + len(sets[j]) - both) and (both or (texts[i] or "") == (texts[j] or "")):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return links, {i: find(i) for i in ids}


def base_scores(rows):
    """(tokens, known, base score) of each (doc_id, text), and the number of training tokens."""
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = Counter(w for i, t in rows if i is not None and crc(i, 10) for w in tokens(t))
    n = sum(c.values())
    norm = math.log10(n + 0.1 * (len(c) + 1))
    return [(len(w), sum(c[x] > 0 for x in w), sum(math.log10(c[x] + 0.1) - norm for x in w)) for w in (tokens(t) for _, t in rows)], n


def auc(scores, labels):
    """Chance that a row of label 1 scores above one of label 0."""
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def class_scores(rows, classes):
    """The log10 probability of each (doc_id, text) by a class bigram model of all rows; words without a class are class 1, ends 0."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    texts = [split(t) for _, t in rows]
    times = Counter(w for t in texts for w in t)
    paths = [[0, *(classes.get(w, 1) for w in t), 0] for t in texts]
    pairs = Counter(p for path in paths for p in zip(path, path[1:]))
    before, after = Counter(), Counter()
    for (a, b), n in pairs.items():
        before[a] += n
        after[b] += n
    used = {0, 1, *classes.values()}
    share = {c: (after[c] + 0.1) / (sum(after.values()) + 0.1 * len(used)) for c in used}
    size, tail = Counter(), {w: n for w, n in times.items() if w not in classes}
    for w, c in classes.items():
        size[c] += times[w]
    once, twice = (sum(n == k for n in tail.values()) for k in (1, 2))
    total = sum(tail.values())
    discount = once / (once + 2 * twice) if once and twice else 0.5

    def emitted(w):
        return times[w] / size[classes[w]] if w in classes else (times[w] - discount) / total

    return [
        sum(math.log10((pairs[a, b] + 2 * share[b]) / (before[a] + 2)) for a, b in zip(path, path[1:])) + sum(math.log10(emitted(w)) for w in t)
        for t, path in zip(texts, paths)
    ]
