"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(rows: list[tuple[int, str | None]], width: int) -> list[tuple[int, int, int, str]]:
    """Every window of every document against the windows that start in smaller ones."""
    first: dict[tuple[str, ...], int] = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        if i is not None:
            for at in range(len(words) - width + 1):
                w = tuple(words[at : at + width])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for at in range(len(words) - width + 1):
            if i is not None and first[tuple(words[at : at + width])] < i:
                gone[at : at + width] = [True] * width
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def shingles(text: str | None, width: int = 5) -> dict[tuple[str, ...], int]:
    words = WORD.findall(text or "")
    out: dict[tuple[str, ...], int] = {}
    n = max(1, min(width, len(words)))
    for at in range(len(words) - n + 1) if words else ():
        w = tuple(words[at : at + n])
        out[w] = out.get(w, 0) + 1
    return out


def similarity(a: dict, b: dict) -> float:
    keys = a.keys() | b.keys()
    total = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / total if total else 0.0


def near_classes(rows: list[tuple[int | None, str | None]], least: float) -> list[int | None]:
    """The least id of each row's connected component; all pairs."""
    bags = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k: int) -> int:
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][0] == rows[j][0]
            if None not in (rows[i][0], rows[j][0]) and (same or similarity(bags[i], bags[j]) >= least):
                up[find(i)] = find(j)
    best: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[find(k)] = min(best.get(find(k), i), i)
    return [None if i is None else best[find(k)] for k, (i, _) in enumerate(rows)]


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text or "")
    windows: dict[tuple[str, ...], list[int]] = {}
    for at in range(len(words) - 2):
        windows.setdefault(tuple(words[at : at + 3]), []).append(at)
    covered = {p for places in windows.values() if len(places) > 1 for at in places for p in range(at, at + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def pii(text: str | None) -> list[tuple[str, int, int]]:
    """The contract's expressions as they stand."""
    text = text or ""

    def luhn(d: str) -> bool:
        total = 0
        for k, c in enumerate(reversed(d)):
            n = int(c) * (2 if k % 2 else 1)
            total += n - 9 if n > 9 else n
        return total % 10 == 0

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return found


def url(text: str | None) -> tuple[str, str]:
    if text is None or "://" not in text:
        return "", ""
    rest = text.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path
