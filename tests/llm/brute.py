"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LAST = (1 << 63) - 1


def plain(text):
    return [w.decode() for w in (text or "").encode().split()]


def folded(text):
    return [w.decode() for w in (text or "").encode().translate(FOLD).split()]


def letters(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().translate(FOLD).decode())


def order(doc_id):
    return LAST if doc_id is None else doc_id


def substrings(docs, window=50):
    first = {}
    for i, text in docs:
        w = plain(text)
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            first[key] = min(first.get(key, LAST), order(i))
    out = []
    for i, text in docs:
        w = plain(text)
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < order(i):
                gone.update(range(at, at + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def shingles(text, size=5):
    w = folded(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1))))


def similar(a, b, percent=75):
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def near_duplicates(docs, size=5, percent=75):
    """(id, set size, smallest id of the component) of every row."""
    sets = [shingles(text, size) for _, text in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and root(a) != root(b) and similar(sets[a], sets[b], percent):
                parent[root(a)] = root(b)
    ids = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            ids[root(k)].append(i)
    return sorted(((i, len(sets[k]), min(ids[root(k)], default=None)) for k, (i, _) in enumerate(docs)), key=str)


def contamination(docs, items, size=13):
    windows = defaultdict(set)
    for name, text in items:
        w = letters(text)
        for at in range(max(len(w) - size + 1, min(len(w), 1))):
            windows[tuple(w[at : at + size])].add("" if name is None else str(name))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, held = letters(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                found = windows.get(tuple(w[at : at + n]))
                if found:
                    hit.update(range(at, at + n))
                    held |= found
        out.append((i, len(w), len(hit), sorted(held)))
    return sorted(out, key=str)


def statistics(text):
    text = text or ""
    w = plain(text)
    threes = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(threes)
    covered = {k + d for k, t in enumerate(threes) if often[t] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if plain(line)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def repeated_lines(docs, percent=75):
    """(id, lines with words, numbers of removed lines) of every row."""
    lines = []
    for k, (i, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            if folded(line):
                lines.append((k, order(i), n, frozenset(folded(line))))
    gone, count = defaultdict(set), Counter(k for k, *_ in lines)
    for k, i, n, own in lines:
        if any((j, m) < (i, n) and similar(own, other, percent) for _, j, m, other in lines):
            gone[k].add(n)
    return sorted(((i, count[k], sorted(gone[k])) for k, (i, _) in enumerate(docs)), key=str)


def aligned_tokens(docs, folder):
    """op12's rows, by one walk over both token lists of each text; with the groups of every row."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = dict(zip(map(chr, shown), shown))
    letter.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in shown))

    def piece(i):
        return bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    rows = []
    for i, text in docs:
        a = [(t, bytes(letter[c] for c in first.id_to_token(t))) for t in first.encode(" " + text, add_special_tokens=False).ids] if text else []
        b = [(t, piece(t)) for t in second.encode(text)] if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append((i, [], [], []))
            continue
        groups, left, right, x, y, n, m = [], [], [], 0, 0, 0, 0
        while x < len(a) or y < len(b):
            if n <= m:
                left.append(a[x][0])
                n, x = n + len(a[x][1]), x + 1
            else:
                right.append(b[y][0])
                m, y = m + len(b[y][1]), y + 1
            if n == m:
                groups.append((left, right))
                left, right = [], []
        rows.append((i, a, b, groups))
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in rows for g in groups)
    most = defaultdict(int)
    for (_, right), c in count.items():
        most[right] = max(most[right], c)
    out = []
    for i, a, b, groups in rows:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append(
            (i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links))
            + (hashlib.sha256(said.encode()).hexdigest() if groups else "", groups)
        )
    return out
