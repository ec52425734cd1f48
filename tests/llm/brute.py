"""Plain Python forms of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
# The contracts' patterns; group that is measured, test.
SECRETS = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_text(spans: list[tuple[int, int, str, int]]) -> str:
    """spans: (start, rank, kind, end)."""
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def secrets(text: str | None) -> tuple[int, int, int, str]:
    spans, n = [], []
    for rank, (kind, (pattern, group, least)) in enumerate(SECRETS.items()):
        found = [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
        n.append(len(found))
        spans += found
    return (*n, sha(spans_text(spans)))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_ok(kind: str, s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": all(int(x) <= 255 for x in s.split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def pii(text: str | None) -> tuple[int, int, int, int, str]:
    spans, n = [], []
    for rank, (kind, pattern) in enumerate(PII.items()):
        found = [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if pii_ok(kind, m.group())]
        n.append(len(found))
        spans += found
    return (*n, sha(spans_text(spans)))


def shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    low = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near(docs: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int, bool]]:
    """doc_id -> (n_shingles, component, kept); doc_ids are distinct."""
    sets = {i: shingles(t, k) for i, t in docs}
    at: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(i)
    both: dict[tuple[int, int], int] = {}
    for ids in at.values():
        for x in range(len(ids)):
            for y in range(x):
                p = (min(ids[x], ids[y]), max(ids[x], ids[y]))
                both[p] = both.get(p, 0) + 1
    top = {i: i for i in sets}

    def find(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def chats(rows: list[tuple]) -> dict[int, tuple[int, str, int, str]]:
    """rows: conv_id, turn, role, text."""
    out: dict[int, list] = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r or "", x or ""))
    made = {}
    for c, turns in out.items():
        turns.sort()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        made[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt))
    return made


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 3, 1, 2, ...; 150 % shared, at most twice a source's size."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out
