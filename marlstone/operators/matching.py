"""Greedy choice over small tables of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def greedy_redundancy(tracks: DataFrame, corr: DataFrame, k: int) -> list[str]:
    """k tracks, one at a time: most relevance less mean |correlation| with those chosen; tables of tracks are small."""
    score = {r.track: r.relevance for r in tracks.collect()}
    pair = {(r.a, r.b): abs(r.r or 0.0) for r in corr.collect()}
    chosen: list[str] = []
    while score and len(chosen) < k:
        cost = lambda t: sum(pair.get((t, c), pair.get((c, t), 0.0)) for c in chosen) / max(1, len(chosen))
        best = min(score, key=lambda t: (-(score[t] - cost(t)), t))
        chosen.append(best)
        del score[best]
    return chosen
