"""Cosines of many vectors with a block of queries: matrix products on Arrow batches, exact after rounding."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

#: Scores that are held at once.
CELLS = 1 << 21
PLACES = 6
SCHEMA = "query_id long, vec_id long, score double"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def lengths(m: np.ndarray) -> np.ndarray:
    """Of each row, its squares added from first to last."""
    return np.sqrt(np.cumsum(m * m, axis=1)[:, -1])


def blocks_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of float64) of the vectors of each width; those that are null, empty or hold nulls have no matrix and aren't listed."""
    sizes = np.array(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten()
    starts = np.cumsum(sizes) - sizes
    holes = np.concatenate([[0], np.cumsum(np.array(values.is_null(), np.int64))])
    whole = (sizes > 0) & (holes[starts + sizes] == holes[starts])
    flat = np.asarray(values.cast(pa.float64()).fill_null(0.0))
    out = []
    for width in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == width))
        out.append((at, flat[starts[at][:, None] + np.arange(width)]))
    return out


def rounded(score: np.ndarray, v: list, vn: np.ndarray, q: list, qn: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Half up to PLACES, as Spark rounds. Near the middle of two values a score is added up from first to last (v[i] and q[j] are its vectors)."""
    y = score * 10.0**PLACES
    out = np.rint(y) / 10.0**PLACES + 0.0
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4):
        exact = float(np.cumsum(v[i[k]] * q[j[k]])[-1]) / float(vn[i[k]] * qn[j[k]])
        out[k] = float(Decimal(repr(exact)).quantize(Decimal(1).scaleb(-PLACES), ROUND_HALF_UP)) + 0.0
    return out


class Best:
    """The `most` best candidates of each query so far; a null score is -inf here, what isn't a number inf."""

    def __init__(self, queries: int, most: int):
        self.most, self.floor = most, np.full(queries, -np.inf)
        self.q, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, score, ids = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        at = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep, last = at < self.most, at == self.most - 1
        self.floor[q[last]] = score[last]
        self.q, self.score, self.ids = q[keep], score[keep], ids[keep]


def scores_of(shared, most: int | None, least: float | None):
    """For mapInArrow over vec_id, v. shared: a broadcast (ids of queries, their vectors).

    With most, each task hands on only that many of a query, those without a score last; least leaves out lower scores and none."""

    def out(asked: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        shown = np.where(np.isposinf(score), np.nan, score)
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids), pa.array(shown, mask=np.isneginf(score), from_pandas=False)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, vectors = np.array(shared.value[0], np.int64), pa.array(shared.value[1], pa.list_(pa.float64()))
        queries = [(at, m, lengths(m)) for at, m in blocks_of(vectors)]
        q, qn = _by_place(queries, len(asked))
        best = None if most is None else Best(len(asked), most)
        step = max(1, CELLS // max(1, len(asked)))
        for batch in batches:
            for part in range(0, batch.num_rows, step):
                rows = batch.slice(part, step)
                rows = rows.filter(rows.column("vec_id").is_valid())
                if not rows.num_rows:
                    continue
                ids = np.asarray(rows.column("vec_id").cast(pa.int64()))
                blocks = [(at, m, lengths(m)) for at, m in blocks_of(rows.column("v"))]
                v, vn = _by_place(blocks, len(ids))
                score = np.full((len(ids), len(asked)), -np.inf)
                with np.errstate(all="ignore"):
                    for at, m, n in blocks:
                        for where, qm, own in queries:
                            if qm.shape[1] == m.shape[1]:
                                both = n[:, None] * own[None, :]
                                cell = np.where(both == 0, -np.inf, (m @ qm.T) / both)
                                score[np.ix_(at, where)] = np.where(np.isnan(cell), np.inf, cell)
                score[ids[:, None] == asked[None, :]] = np.nan  # a query isn't its own neighbour
                floor = np.full(len(asked), -np.inf if least is None else least)
                if best is not None:
                    floor = np.maximum(floor, best.floor)
                    if len(ids) > most:  # only these and their ties can be among the best
                        floor = np.maximum(floor, np.partition(np.where(np.isnan(score), -np.inf, score), len(ids) - most, axis=0)[len(ids) - most])
                i, j = np.nonzero(score >= floor - 2 * 10.0**-PLACES)
                value = score[i, j]
                real = np.isfinite(value)
                value[real] = rounded(value[real], v, vn, q, qn, i[real], j[real])
                if least is not None:
                    keep = value >= least
                    i, j, value = i[keep], j[keep], value[keep]
                if best is None:
                    yield out(asked[j], ids[i], value)
                else:
                    best.add(j, value, ids[i])
        if best is not None:
            yield out(asked[best.q], best.ids, best.score)

    return run


def _by_place(blocks: list, many: int) -> tuple[list, np.ndarray]:
    """The vector of each place, or None, and its length."""
    vectors, norm = [None] * many, np.zeros(many)
    for at, m, n in blocks:
        norm[at] = n
        for k, a in enumerate(at):
            vectors[a] = m[k]
    return vectors, norm
