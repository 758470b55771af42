"""Near-duplicate embeddings by spherical-cap filters from structured random product codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, save, with_group_size
from .components import components
from .grouped import in_blocks, whole_runs

#: Directions in each half's code at least, so CODES ** 2 filters; independent codes; classes of vectors for each filter at most.
CODES, CODES_USED, OCCUPANCY = 256, 3, 4
#: Share of random pairs at the cosine asked for that must meet in a filter; pairs drawn to find the caps that do so.
RECALL, DRAWN = 0.998, 2000
#: Filters that each vector gets in each code at least, its best ones where too few caps hold it.
FEWEST = 4
#: Directions of each half that cap() tries for a pair.
TOP = 64
#: Groups above BLOCK are compared in pairs of blocks, those up to SMALL many at a time.
BLOCK, SMALL = 1024, 16
SEED = 8


def codes(dim: int, repeat: int, n: int = CODES) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation of dim dimensions and, for each half of them, n random unit directions."""
    rng = np.random.default_rng([SEED, dim, repeat])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    directions = rng.normal(size=(2, n, dim // 2))
    return rotation, directions / np.linalg.norm(directions, axis=2, keepdims=True)


def products(vectors: np.ndarray, repeat: int, n: int) -> np.ndarray:
    """Inner products of each unit vector's halves with the directions of their codes, two rows of n a vector.

    Halves are brought to the same length first, which evens out how many filters the vectors get; close
    vectors have close halves, so they still meet.
    """
    dim = vectors.shape[1] + vectors.shape[1] % 2
    padded = np.pad(vectors, ((0, 0), (0, dim - vectors.shape[1])))
    rotation, directions = codes(dim, repeat, n)
    halves = (padded @ rotation).reshape(len(vectors), 2, dim // 2)
    halves = halves / np.maximum(np.linalg.norm(halves, axis=2, keepdims=True), 1e-30)
    return np.einsum("nmd,mkd->nmk", halves, directions) / 2


def cap(dim: int, cosine: float, n: int = CODES, repeats: int = CODES_USED, recall: float = RECALL, drawn: int = DRAWN) -> float:
    """The largest inner product from which filters may take vectors of dim components, for this recall at this cosine.

    Random pairs at the cosine are put through the codes themselves: a pair meets where the cap reaches
    down to the filter whose worse product with the two is best. Of large codes only the TOP directions
    nearest to both are tried, which can only make the caps wider.
    """
    rng = np.random.default_rng([SEED, dim, repeats])
    first, other = rng.normal(size=(2, drawn, dim))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    across = other - (other * first).sum(axis=1, keepdims=True) * first
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-30)
    second = cosine * first + np.sqrt(max(0.0, 1 - cosine * cosine)) * across
    best = np.full(drawn, -1.0)
    for repeat in range(repeats):
        pairs = zip(products(first, repeat, n).astype(np.float32), products(second, repeat, n).astype(np.float32), strict=True)
        met = []
        for x, y in pairs:
            a, b = (np.argsort(-(x[h] + y[h]))[:TOP] for h in (0, 1))
            met.append(np.minimum(x[0][a][:, None] + x[1][b], y[0][a][:, None] + y[1][b]).max())
        best = np.maximum(best, met)
    return float(np.sort(best)[int((1 - recall) * drawn)]) - 1e-6


def decode(vectors: np.ndarray, repeat: int, n: int, alpha: float, fewest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters with an inner product of at least alpha with each unit vector.

    A filter is a pair of directions, one for each half of the rotated vector; its inner product is the sum
    of theirs, so a direction of one half is only paired while the best of the other half could
    still reach alpha. A vector that fewer than `fewest` filters take gets its best ones instead.
    """
    rows, filters = [], []
    for i, (a, b) in enumerate(products(vectors, repeat, n)):
        left = np.flatnonzero(a >= alpha - b.max())
        right = np.flatnonzero(b >= alpha - a.max())
        u, v = np.nonzero(a[left][:, None] + b[right][None, :] >= alpha)
        if len(u) < fewest:  # the best sums are among those of each half's best
            left, right = np.argsort(-a)[:fewest], np.argsort(-b)[:fewest]
            u, v = np.unravel_index(np.argsort(-(a[left][:, None] + b[right][None, :]), axis=None)[:fewest], (len(left), len(right)))
        rows.append(np.full(len(u), i))
        filters.append(left[u] * n + right[v])
    return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *filters])


def unit_vectors(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, divided by their largest component and then by their length."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepared(table: DataFrame, id_col: str, vector_col: str, label_col: str, real: str) -> DataFrame:
    """vec_id, label, d1, d2 (digest of the direction), raw (components as stored), ok of each row."""

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, d1, d2, ok = [], [], [], []
            for v in batch.column(1):
                x = np.array([np.nan if c is None else c for c in v.as_py() or []], dtype=real)
                good = len(x) > 0 and bool(np.isfinite(x).all() and x.any())
                raw.append(x.tobytes() if good else b"")
                digest = np.frombuffer(xxhash.xxh3_128_digest(unit_vectors(x[None]).tobytes() if good else b""), dtype=np.int64)
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                ok.append(good)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(raw, pa.binary()), pa.array(ok, pa.bool_())], ["vec_id", "label", "d1", "d2", "raw", "ok"])

    label_type = table.schema[label_col].dataType.simpleString()
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    return rows.mapInArrow(prepared, f"vec_id long, label {label_type}, d1 long, d2 long, raw binary, ok boolean")


def _caps(classes: DataFrame, cosine: float, n: int, repeats: int, real: str) -> dict[int, float]:
    """The cap of each width of vectors, found on the executors; one number for each width comes back."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array([cap(d, cosine, n, repeats) for d in dims], pa.float64())], ["dim", "alpha"])

    dims = classes.select((F.octet_length("raw") / np.dtype(real).itemsize).cast("int").alias("dim")).distinct()
    return {r["dim"]: r["alpha"] for r in dims.mapInArrow(found, "dim int, alpha double").collect()}


def _filters(classes: DataFrame, n: int, alphas: dict[int, float], repeats: int, real: str) -> DataFrame:
    """(key, space, filter, rep, copies, raw, own): a row for each class and filter.

    own lists all filters of the class (sorted, 4 bytes each), so that a pair of classes can tell, wherever it
    meets, which filter is the first that both have. space stands for label and width; key for space and filter.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            widths = np.array([len(x) // np.dtype(real).itemsize for x in raws])
            for dim in np.unique(widths):
                of = np.flatnonzero(widths == dim)
                for start in range(0, len(of), 1000):
                    part = of[start : start + 1000]
                    units = unit_vectors(np.frombuffer(b"".join(raws[i] for i in part), dtype=real).reshape(-1, dim))
                    found = [decode(units, repeat, n, alphas[int(dim)], FEWEST) for repeat in range(repeats)]
                    row = np.concatenate([r for r, _ in found])
                    chosen = np.concatenate([c + k * n * n for k, (_, c) in enumerate(found)])
                    order = np.lexsort((chosen, row))
                    row, chosen = row[order], chosen[order]
                    bounds = np.searchsorted(row, np.arange(len(part) + 1))
                    lists = [chosen[a:b].astype("<u4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                    at = pa.array(part[row])
                    columns = [batch.column(c).take(at) for c in ("space", "rep", "copies", "raw")]
                    yield pa.RecordBatch.from_arrays([columns[0], pa.array(chosen), *columns[1:], pa.array([lists[i] for i in row], pa.binary())], ["space", "filter", "rep", "copies", "raw", "own"])

    rows = classes.select(F.xxhash64("label", F.octet_length("raw")).alias("space"), "rep", "copies", "raw").mapInArrow(listed, "space long, filter long, rep long, copies long, raw binary, own binary")
    return rows.select(F.xxhash64("space", "filter").alias("key"), "*")


def _first_meeting(lists: list[np.ndarray], u: np.ndarray, v: np.ndarray, at: int) -> np.ndarray:
    """Whether the pairs (u, v) of members have no common filter below `at`, by products of their incidence rows."""
    out = np.ones(len(u), dtype=bool)
    if not len(u):
        return out
    active, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    earlier = [x[x < at] for x in (lists[k] for k in active)]
    names, counts = np.unique(np.concatenate(earlier), return_counts=True)
    names = names[counts > 1]  # a filter that one member has alone is no meeting
    for start in range(0, len(names), 4096):
        part = names[start : start + 4096]
        has = np.zeros((len(active), len(part)), dtype=np.float32)
        for k, x in enumerate(earlier):
            x = x[(x >= part[0]) & (x <= part[-1])]
            place = np.searchsorted(part, x)
            has[k, place[part[place] == x]] = 1
        if len(a) > 4 * len(active):
            out &= (has @ has.T)[a, b] == 0
        else:
            out &= np.einsum("ij,ij->i", has[a], has[b]) == 0
    return out


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches by the links (u, v)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _counted(filters: DataFrame, cosine: float, real: str) -> DataFrame:
    """(rep, to, c): with `to` null, that a class has c further vectors linked in a group; else that it reaches `to` there.

    Classes that share a filter are compared in double precision, groups of any size in blocks. A pair meets in
    every filter that both have and counts in the first of them only, so pairs are never listed: a
    group gives at most two rows for each member.
    """
    dealt = in_blocks(with_group_size(filters, "key", "n", BLOCK, "rep"), "key", "rep", "n", BLOCK, ["space", "filter", "copies", "raw", "own"])

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x * y).sum(axis=1) >= cosine

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ["key", "i", "j"]):
            ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
            i, j, space, number = (table.column(c).to_numpy() for c in ("i", "j", "space", "filter"))
            raws = table.column("raw").to_pylist()
            lists = [np.frombuffer(x, dtype="<u4") for x in table.column("own").to_pylist()]
            widths = np.array([len(x) for x in raws])
            sizes = np.diff(starts)
            run = np.repeat(np.arange(len(sizes)), sizes)
            last = starts[1:][run]
            pairs: list[tuple[np.ndarray, np.ndarray]] = []

            def meet(at: np.ndarray, other: np.ndarray) -> None:
                """Keeps those of the pairs that are close and meet here first; all of one run."""
                fits = (widths[at] == widths[other]) & (space[at] == space[other]) & ((i[at] == j[at]) | (block[at] != block[other]))
                at, other = at[fits], other[fits]
                if not len(at):
                    return
                for width in np.unique(widths[at]):
                    of = widths[at] == width
                    members, inverse = np.unique(np.concatenate([at[of], other[of]]), return_inverse=True)
                    x = unit_vectors(np.frombuffer(b"".join(raws[k] for k in members), dtype=real).reshape(len(members), -1))
                    a, b = inverse[: of.sum()], inverse[of.sum() :]
                    near = np.concatenate([close(x[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)])
                    pairs.append((members[a[near]], members[b[near]]))

            small = np.flatnonzero(sizes[run] <= SMALL)
            for d in range(1, SMALL):
                at = small[small + d < last[small]]
                if not len(at):
                    break
                meet(at, at + d)
            if pairs:
                u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
                first = np.fromiter((_none_below(lists[a], lists[b], number[a]) for a, b in zip(u.tolist(), v.tolist(), strict=True)), bool, len(u))
                yield from told(ids, copies, run, u[first], v[first])
            for r in np.flatnonzero(sizes > SMALL):
                a, b = int(starts[r]), int(starts[r + 1])
                u, v = _close_in(raws[a:b], widths[a:b], space[a:b], block[a:b], i[a] == j[a], cosine, real)
                first = _first_meeting(lists[a:b], u, v, int(number[a]))
                yield from told(ids[a:b], copies[a:b], np.zeros(b - a, np.int64), u[first], v[first])

    def told(ids: np.ndarray, copies: np.ndarray, run: np.ndarray, u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(u):
            return
        c = np.zeros(len(ids), dtype=np.int64)
        np.add.at(c, u, copies[v])
        np.add.at(c, v, copies[u])
        root = _roots(len(ids), u, v)
        linked, below = np.flatnonzero(c), np.flatnonzero(root != np.arange(len(ids)))
        rep = pa.array(np.concatenate([ids[linked], ids[below]]))
        to = pa.array([None] * len(linked) + ids[root[below]].tolist(), pa.int64())
        yield pa.RecordBatch.from_arrays([rep, to, pa.array(np.concatenate([c[linked], np.zeros(len(below), np.int64)]))], ["rep", "to", "c"])

    return dealt.mapInArrow(compared, "rep long, to long, c long")


def _none_below(a: np.ndarray, b: np.ndarray, at: int) -> bool:
    return np.intersect1d(a[: np.searchsorted(a, at)], b[: np.searchsorted(b, at)], assume_unique=True).size == 0


def _close_in(raws: list[bytes], widths: np.ndarray, space: np.ndarray, block: np.ndarray, within: bool, cosine: float, real: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions (u, v) of the close pairs of a run: of all its members, or between its two blocks."""
    us, vs = [], []
    for width in np.unique(widths):
        for where in np.unique(space[widths == width]):
            of = np.flatnonzero((widths == width) & (space == where))
            x = unit_vectors(np.frombuffer(b"".join(raws[k] for k in of), dtype=real).reshape(len(of), -1))
            sides = (of, of) if within else (of[block[of] == block[of].min()], of[block[of] != block[of].min()])
            place = np.zeros(len(raws), dtype=np.int64)
            place[of] = np.arange(len(of))
            for at in range(0, len(sides[0]), 512):
                own = sides[0][at : at + 512]
                u, v = np.nonzero(x[place[own]] @ x[place[sides[1]]].T >= cosine)
                u, v = own[u], sides[1][v]
                once = u < v if within else np.ones(len(u), bool)
                us.append(u[once])
                vs.append(v[once])
    return np.concatenate([np.empty(0, np.int64), *us]), np.concatenate([np.empty(0, np.int64), *vs])


def near_vectors(table: DataFrame, cosine: float = 0.98, n: int | None = None, repeats: int = CODES_USED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of one label with a cosine of at least `cosine`, in double precision.

    Vectors with the same label and direction, to the last bit, are one class. Each class is listed under all
    filters whose cap holds it, in three independent product codes, and classes that share a filter are
    compared. The caps follow the vectors' width and the cosine: they are as small as finds RECALL of
    random pairs at that cosine, and more of closer ones. The codes have `n` directions a half; unless given,
    n grows with the number of classes so that filters stay at OCCUPANCY classes each.

    Returns vec_id, n_links (other vectors linked directly), component_id (the smallest id reached), kept. Rows
    whose label or vector is null, or whose vector is empty, zero or holds null or non-finite
    numbers, are linked with nothing and kept. Vectors of different lengths are never linked. Rows that
    repeat an id are vectors of their own that the id joins, and their links add up where they differ.
    Other columns are not read.
    """
    real = "<f4" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = save(_prepared(table, id_col, vector_col, label_col, real).withColumn("_row", F.monotonically_increasing_id()))
    usable = rows.where(F.col("ok") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = save(usable.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    if n is None:
        n, most = CODES, classes.count()
        while most > OCCUPANCY * n * n:
            n *= 2
    filters = save(_filters(classes, n, _caps(classes, cosine, n, repeats, real), repeats, real))
    found = save(_counted(filters, cosine, real))
    roots = components(found.where("to IS NOT NULL").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = found.where("to IS NULL").groupBy(F.col("rep").alias("_rep")).agg(F.sum("c").alias("others"))
    by_class = save(
        classes.select("label", "d1", "d2", "rep", "copies")
        .join(roots, F.col("rep") == F.col("id"), "left")
        .join(counts, F.col("rep") == F.col("_rep"), "left")
        .select("label", "d1", "d2", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    alone = rows.where(~(F.col("ok") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("root"))
    linked = join_skewed(usable.drop("raw", "ok"), by_class, ["label", "d1", "d2"], "copies", "_row").select("vec_id", "n_links", "root")
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("root").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("root")).alias("kept"))
