"""Plain-Python versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near_groups(docs: list[tuple], n: int = 5, percent: int = 75) -> list[tuple]:
    sets = []
    for _, text in docs:
        w = SPACE_WORD.findall(lower_ascii(text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[find(a)] = find(b)
    least: dict = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    out = []
    for i, (doc, _) in enumerate(docs):
        c = least.get(find(i)) if sets[i] else doc
        out.append((doc, len(sets[i]), c, doc == c))
    return out


def contamination(docs: list[tuple], items: list[tuple], span: int = 13) -> list[tuple]:
    windows = defaultdict(set)
    sizes = set()
    for item, text in items:
        w = ALNUM_WORD.findall(lower_ascii(text or ""))
        n = min(span, len(w))
        if not n or item is None:
            continue
        sizes.add(n)
        for i in range(len(w) - n + 1):
            windows[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w = ALNUM_WORD.findall(lower_ascii(text or ""))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def repeats_removed(docs: list[tuple], span: int = 35) -> list[tuple]:
    words = [SPACE_WORD.findall(text or "") for _, text in docs]
    seen = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for (doc, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone.update(range(i, i + span))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def quality_base(text: str | None) -> tuple:
    text = text or ""
    w = SPACE_WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeat = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), failed


def line_key(line: str) -> str:
    return lower_ascii(line.strip(" \t\n\x0b\x0c\r"))


def quality_lines(docs: list[tuple], least: int = 10, share: float = 0.7) -> list[tuple]:
    """Per document ``(id, text, host)``: words removed, text left, kept."""
    found = defaultdict(set)
    for _, text, host in docs:
        for line in (text or "").split("\n"):
            if SPACE_WORD.search(line):
                found[host, line_key(line)].add(text)
    out = []
    for _, text, host in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not SPACE_WORD.search(x) or len(found[host, line_key(x)]) < least]
        n, rest = (len(SPACE_WORD.findall(x)) for x in (text or "", "\n".join(kept)))
        depleted = rest < n and (rest < 10 or rest < share * n)
        out.append((n - rest, "\n".join(kept), not quality_base(text)[-1] and not depleted))
    return out


def lines_left(texts: list, least: int = 10) -> list[str]:
    count = Counter(k for text in texts for k in {line_key(x) for x in (text or "").split("\n")})
    return ["\n".join(x for x in (text or "").split("\n") if not line_key(x) or count[line_key(x)] < least) for text in texts]


def lines_dropped(docs: list[tuple], least: int = 10) -> list[tuple]:
    out = []
    for (doc, text), left in zip(docs, lines_left([t for _, t in docs], least), strict=True):
        lines = (text or "").split("\n")
        n = sum(Counter(lines).values()) - (len(left.split("\n")) if left or "" in lines else 0)
        out.append((doc, len(lines), n, sha(left)))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text: str | None) -> tuple:
    text = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    kinds = ["email", "ip", "card", "phone"]
    counts = Counter(k for _, k, _ in spans)
    return *(counts[k] for k in range(4)), sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans)))


def token_pieces(docs: list[tuple], encode, capacity: int = 1024, end: int = 2) -> dict:
    out = {}
    for doc, text in docs:
        ids = [*encode(text or ""), end]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for i, start in enumerate(cuts):
            stop = cuts[i + 1] if i + 1 < len(cuts) else len(ids)
            data = b"".join(x.to_bytes(4, "little") for x in ids[start:stop])
            out[doc, i] = (start, stop - start, zlib.crc32(data))
    return out
