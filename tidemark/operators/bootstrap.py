"""Resampling whole days with one weight a draw: vectors of draws in the place of multiplied rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def draw_matrix(days: int, draws: int, seed: int) -> np.ndarray:
    """(draws + 1, days): how often each draw takes each day; row 0 takes each once.

    The i-th pick of a draw is the day numbered MD5(seed:draw:i) modulo the days, from 0, so that reruns and
    other engines draw alike.
    """
    out = np.zeros((draws + 1, days))
    out[0] = 1
    for r in range(draws):
        picks = [int(hashlib.md5(f"{seed}:{r}:{i}".encode()).hexdigest()[:8], 16) % days for i in range(days)]
        out[r + 1] = np.bincount(picks, minlength=days)
    return out


class RankSums:
    """For every draw: weights of both classes and the rank-sum wins of the positives, over rows in order of their scores."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.pos, self.neg, self.wins = (np.zeros(len(weights)) for _ in range(3))
        self.tied: tuple[float, np.ndarray, np.ndarray] | None = None  # the last score's rows, of which more may come

    def add(self, score: np.ndarray, day: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        starts = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        w = self.weights[:, day]
        p, n = np.add.reduceat(w * pos, starts, axis=1), np.add.reduceat(w * neg, starts, axis=1)
        if self.tied is not None and self.tied[0] == score[0]:
            p[:, 0] += self.tied[1]
            n[:, 0] += self.tied[2]
        else:
            self.close()
        self.tied = float(score[-1]), p[:, -1].copy(), n[:, -1].copy()
        p, n = p[:, :-1], n[:, :-1]
        below = self.neg[:, None] + np.cumsum(n, axis=1) - n
        self.wins += (p * (below + n / 2)).sum(axis=1)
        self.pos += p.sum(axis=1)
        self.neg += n.sum(axis=1)

    def close(self) -> None:
        if self.tied is not None:
            _, p, n = self.tied
            self.wins += p * (self.neg + n / 2)
            self.pos += p
            self.neg += n
            self.tied = None


def rank_sums(batches: Iterator[pa.RecordBatch], keys: list[str], draws: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One row of RankSums for each stretch of equal keys in rows in order of (keys, score): keys, low, pos, neg, wins.

    Rows have keys, score, day (its number in the group), days (of the group), pos and neg. Memory is that
    of one batch times the draws.
    """
    current, sums, low = None, None, 0.0
    matrices: dict[int, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        sums.close()
        arrays = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (sums.pos, sums.neg, sums.wins)]
        return pa.RecordBatch.from_arrays([*current, pa.array([low]), *arrays], [*keys, "low", "pos", "neg", "wins"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        score, day, days, pos, neg = (batch.column(c).to_numpy() for c in ("score", "day", "days", "pos", "neg"))
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = [batch.column(k).slice(a, 1) for k in keys]
            if current is None or [x.to_pylist() for x in current] != [x.to_pylist() for x in key]:
                if current is not None:
                    yield told()
                n = int(days[a])
                if n not in matrices:
                    matrices = {n: draw_matrix(n, draws, seed)}
                current, sums, low = key, RankSums(matrices[n]), float(score[a])
            for at in range(a, b, 4096):
                part = slice(at, min(b, at + 4096))
                sums.add(score[part], day[part], pos[part], neg[part])
    if current is not None:
        yield told()


def joined_sums(low: np.ndarray, pos: np.ndarray, neg: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """The area under the curve in each draw, from the sums of stretches of scores; NaN where a draw has one class only."""
    order = np.argsort(low)
    below, total, p = np.zeros(pos.shape[1]), np.zeros(pos.shape[1]), np.zeros(pos.shape[1])
    for k in order:
        total += wins[k] + pos[k] * below
        below += neg[k]
        p += pos[k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p * below > 0, total / (p * below), np.nan)


def with_ends(draws: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """(value, low, high): row 0's figure and the interpolated 2.5 % and 97.5 % points of the others; None where undefined."""
    point = None if np.isnan(draws[0]) else float(draws[0])
    known = draws[1:][~np.isnan(draws[1:])]
    return (point, None, None) if not len(known) else (point, float(np.percentile(known, 2.5)), float(np.percentile(known, 97.5)))
