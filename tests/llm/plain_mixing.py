"""Bounded raking of cells in plain loops, for tests."""

from __future__ import annotations

import hashlib
from collections import Counter


def draw(doc_id) -> float:
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:13], 16) / 2**52


def filled(share: dict, has: dict) -> dict:
    """Shares no larger than has; the rest goes to the others in proportion: the smallest has / share first."""
    order, left, rest, out = sorted(share, key=lambda x: has[x] / share[x]), 1.0, sum(share.values()), {}
    for x in order:
        out[x] = min(has[x], share[x] * left / rest)
        left, rest = left - out[x], rest - share[x]
    return out


def margins(shares: dict) -> list[Counter]:
    found = [Counter() for _ in range(3)]
    for c, x in shares.items():
        for k in range(3):
            found[k][c[k]] += x
    return found


def bounded(cells: dict, keep: float, temper: float, rounds: int = 60, tolerance: float = 1e-4) -> tuple[dict, list[Counter], float]:
    """cells: (source, lang, topic) to tokens. Weights of the cells, targets and the largest gap."""
    total, limit = sum(cells.values()), 1 / keep
    raised = sum(n**temper for n in cells.values())
    goals = margins(filled({c: n**temper / raised for c, n in cells.items()}, {c: n / (keep * total) for c, n in cells.items()}))
    w = dict.fromkeys(cells, 1.0)
    for done in range(rounds + 1):
        now = margins({c: n * min(w[c], limit) / total for c, n in cells.items()})
        gap = max(abs(now[k][v] / g - 1) for k in range(3) for v, g in goals[k].items())
        if done == rounds or (done % 3 == 0 and gap <= tolerance):
            return {c: min(x, limit) for c, x in w.items()}, goals, gap
        for k in range(3):
            for v, g in goals[k].items():
                own = [c for c in cells if c[k] == v]
                held = sum(cells[c] * limit for c in own if w[c] >= limit) / total
                free = sum(cells[c] * w[c] for c in own if w[c] < limit) / total
                now_v = sum(cells[c] * min(w[c], limit) for c in own) / total
                for c in own:
                    if g < held:
                        w[c] = min(w[c], limit) * g / now_v
                    elif free > 0:
                        w[c] *= (g - held) / free
