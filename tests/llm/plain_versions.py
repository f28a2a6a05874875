"""Plain-Python versions of the contracts, for small tables."""

import hashlib
import re
from collections import defaultdict


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def repeats(docs: list[tuple], width: int = 35) -> dict:
    count = defaultdict(int)
    for _, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            count[tuple(w[i:i + width])] += 1
    out = {}
    for key, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone |= set(range(i, i + width))
        out[key] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def near_groups(docs: list[tuple], width: int = 4) -> dict:
    sets = {}
    for key, text in docs:
        w = words(lower(text or ""))
        sets[key] = ({tuple(w[i:i + width]) for i in range(len(w) - width + 1)}
                     if len(w) >= width else {tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def hits(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    w, hit, found = item_words(text), set(), set()
    for item, item_text in items:
        v = item_words(item_text)
        for part in ([v] if 0 < len(v) < window else
                     [v[i:i + window] for i in range(len(v) - window + 1)]):
            for i in range(len(w) - len(part) + 1):
                if part and w[i:i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def alignment(texts: list, a_path: str, b_path: str) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) per text, byte range by byte range."""
    import sentencepiece
    from tokenizers import Tokenizer

    letters = {}
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(spare)] = b
            spare += 1
    left = Tokenizer.from_file(a_path)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=b_path)
    rows, count = [], defaultdict(int)
    for text in texts:
        a = left.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in left.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i)
                   else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != b"".join(b_bytes) or b"".join(a_bytes) != (" " + (text or "")).encode():
            a, b, a_bytes, b_bytes = [], [], [], []
        ends = lambda parts: [sum(map(len, parts[:i + 1])) for i in range(len(parts))]
        a_end, b_end = ends(a_bytes), ends(b_bytes)
        links = [(x, y) for x, e in zip(a, a_end) for y, f in zip(b, b_end) if e == f]
        groups, i, j = [], 0, 0
        for e in sorted(set(a_end) & set(b_end)):
            p, q = a_end.index(e) + 1, b_end.index(e) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        for pair in links:
            count[pair] += 1
        rows.append((len(a), len(b), len(groups), links, sha(";".join(groups)) if groups else ""))
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(a, b, g, len(links), sum(count[p] == most[p[1]] for p in links),
             sum(count[p] for p in links), digest) for a, b, g, links, digest in rows]


def hard_negatives(rows: list[tuple]) -> list[tuple]:
    """rows: (id, vector, label). Sorted (anchor, positive, rank, negative, scores)."""
    import math

    used = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if key is not None and key % 7 == 0:
            label = (label + 1) % 10
        used.append((key, [math.floor(256 * x) for x in vector], label))
    order = lambda pair: (-pair[0], pair[1] is None, pair[1] or 0)
    out = []
    for i, (key, v, label) in enumerate(used):
        if key is None or key % 100:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), k, g, j) for j, (k, w, g) in enumerate(used) if j != i]
        for ps, pk, *_ in sorted((s for s in scores if s[2] == label), key=order)[:5]:
            fits = [s for s in scores if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps]
            for rank, (ns, nk, *_) in enumerate(sorted(fits, key=order)[:5], 1):
                out.append((key, pk, rank, nk, ps, ns))
    return sorted(out, key=repr)
