"""Near-duplicate vectors, by distances in subspaces.

Unit vectors with cosine t or more are at most sqrt(2 - 2 t) apart, and no
further in any subspaces. A rotation fitted to the main directions of a sample
(a million numbers at most; the result is exact with any rotation) puts the
coordinates that spread most first. These leading ones are kept, the others are
split into blocks of dimensions of which the lengths are kept: a vector's
shadow. It is a unit vector too, and the cosine of two shadows is never below
that of their vectors.

Vectors are dealt into cells of like shadows and packed into bundles of bounded
size, in order of their place, with the range of every coordinate. Bundles are
joined by range: two meet if their ranges are near enough. That join reads the
table of bundles again for each pair, and shuffles nothing: disk grows with the
vectors, whatever the number of pairs. Each pair is a tile, in which chunks are
joined by range in the same way; pairs with shadows near enough are found with
a matrix product and then verified with the whole vectors in double precision.

Equal vectors, by the SHA-256 of their bytes, are one class with a size, so
copies make no pairs. A tile returns sums of links and a spanning forest of its
links, never the pairs.

Defined results: null, empty and zero vectors, and those with null or
non-finite components, link with nothing; so do rows without an id, and vectors
of different length with each other. Repeated rows are vectors of their own. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treelens.llm.graph import components
from treelens.operators.workspace import written


@dataclass(frozen=True)
class VectorRules:
    """Least cosine, dimensions per block, rows of a bundle in a small table, and bytes of one in a large table."""

    cosine: float = 0.9
    block: int = 16
    part: int = 4096
    seed: int = 41
    bundle: int = 1 << 23


COARSE_SLACK = 1e-5  # of shadows, which are in single precision
SAMPLE_NUMBERS = 1 << 20  # that the rotation and the cells are fitted to
LARGEST_ROTATION = 2048  # longer vectors are left as they are
ROWS = 2048  # turned at once
CHUNK, COLUMNS = 256, 512  # rows with a range of their own in a tile, and columns of one product
# Of shadows of vectors without structure, so many standard deviations stay below the least cosine.
DEVIATIONS = 4.5


@lru_cache(maxsize=8)
def rotation(size: int, seed: int) -> np.ndarray:
    """A fixed random rotation, which spreads a difference over all blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def leading(size: int, rules: VectorRules) -> int:
    """How many coordinates of a shadow are kept one by one."""
    root = (DEVIATIONS + sqrt(DEVIATIONS**2 + 4 * (1 - rules.cosine) * size)) / 2
    return min(size, ceil(root * root))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shadows(x: np.ndarray, turn: np.ndarray | None, rules: VectorRules) -> np.ndarray:
    """Leading coordinates of the vectors' directions, and the lengths of their blocks of others."""
    size = x.shape[1]
    if turn is None and size <= LARGEST_ROTATION:
        turn = rotation(size, rules.seed)
    own = leading(size, rules)
    n = max(1, round((size - own) / rules.block))
    cuts = [(size - own) * k // n for k in range(n)]

    def some(x: np.ndarray) -> np.ndarray:
        turned = unit(x) if turn is None else unit(x) @ turn
        if own == size:
            return turned.astype(np.float32)
        lengths = np.sqrt(np.add.reduceat(turned[:, own:] ** 2, cuts, axis=1))
        return np.hstack([turned[:, :own], lengths]).astype(np.float32)

    return np.concatenate([some(x[at : at + ROWS]) for at in range(0, len(x), ROWS)])


def widest(points: np.ndarray) -> int:
    return int(points.std(axis=0).argmax())


def splits(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Cuts of space into cells with like shares of `points`: axis, value, and what lies below and above.

    A negative number is a cell, ~0 the first.
    """
    nodes: list = []
    cells = iter(range(leaves))

    def grow(inside: np.ndarray, wanted: int) -> int:
        axis = widest(inside) if wanted > 1 and len(inside) > 1 else 0
        value = float(np.quantile(inside[:, axis], (wanted // 2) / wanted)) if len(inside) else 0.0
        under = inside[:, axis] <= value
        if wanted == 1 or under.all() or not under.any():
            return ~next(cells)
        at = len(nodes)
        nodes.append(None)
        nodes[at] = (axis, value, grow(inside[under], wanted // 2), grow(inside[~under], wanted - wanted // 2))
        return at

    grow(points, leaves)
    return nodes


def cells(points: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The cell of every point."""
    if not nodes:
        return np.zeros(len(points), np.int64)
    axis, value, below, above = (np.array(column) for column in zip(*nodes, strict=True))
    at = np.zeros(len(points), np.int64)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        at[inner] = np.where(points[inner, axis[node]] <= value[node], below[node], above[node])
    return ~at


def in_chunks(points: np.ndarray) -> np.ndarray:
    """An order in which every chunk holds points of like place."""

    def cut(inside: np.ndarray) -> Iterator[np.ndarray]:
        if len(inside) <= CHUNK:
            yield inside
            return
        half = CHUNK * ((len(inside) + CHUNK) // (2 * CHUNK))
        inside = inside[np.argpartition(points[inside, widest(points[inside])], half)]
        yield from cut(inside[:half])
        yield from cut(inside[half:])

    return np.concatenate(list(cut(np.arange(len(points)))))


@dataclass(frozen=True)
class Fit:
    """What a sample says about the vectors of one length."""

    turn: np.ndarray | None
    nodes: list[tuple[int, float, int, int]]
    rows: int  # of a bundle


def valid(vector: str) -> Column:
    entries = F.col(vector)
    fine = F.forall(entries, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    some = F.exists(entries, lambda e: e != 0)
    return F.coalesce(fine & some, F.lit(False))


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The components of all vectors in a row; equal ones have equal bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False) + 0  # no -0


def by_size(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The places of vectors, by their length."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield int(size), pa.array(np.flatnonzero(sizes == size))


def digests(column: pa.Array) -> pa.Array:
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = numbers(column)
    data, ends = memoryview(flat).cast("B"), np.cumsum(lengths) * flat.itemsize
    starts = ends - lengths * flat.itemsize
    return pa.array([sha256(data[a:b]).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())


def fitted(good: DataFrame, total: int, rules: VectorRules) -> dict[int, Fit]:
    """Rotation and cells per length of vectors, from a sample of the distinct ones."""
    every = max(1, ceil(total / SAMPLE_NUMBERS))
    part = good.where(F.pmod(F.xxhash64("embedding"), F.lit(every)) == 0)
    column = part.select("embedding").distinct().toArrow().column("embedding").combine_chunks()
    fits = {}
    for size, places in by_size(column):
        own = column.take(places)
        x, n = numbers(own).reshape(-1, size), len(own) * every
        turn = None
        if len(own) > size and size <= LARGEST_ROTATION:
            turn = np.linalg.eigh(np.cov(unit(x).T).reshape(size, size))[1][:, ::-1]
        width = size * own.type.value_type.bit_width // 8 + 16
        rows = max(1, min(rules.bundle // width, max(rules.part, n // 16)))
        fits[size] = Fit(turn, splits(shadows(x, turn, rules), ceil(n / rows)), rows)
    return fits


def distinct(table: pa.Table) -> pa.Table:
    """One row per digest, with the smallest id and the sum of `n`."""
    places = pa.array(np.arange(len(table)))
    found = table.select(["digest", "id", "n"]).append_column("at", places).group_by("digest", use_threads=False)
    found = found.aggregate([("id", "min"), ("n", "sum"), ("at", "min")])
    first = table.take(found["at_min"])
    return first.set_column(first.schema.get_field_index("id"), "id", found["id_min"]).set_column(
        first.schema.get_field_index("n"), "n", found["n_sum"]
    )


def bundles(good: DataFrame, fits: dict[int, Fit], rules: VectorRules) -> DataFrame:
    """Distinct vectors of a cell as one row or a few, in chunks, with the range of each coordinate of their shadows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(
                {
                    "digest": digests(batch.column(1)),
                    "id": batch.column(0),
                    "n": np.ones(batch.num_rows, np.int64),
                    "embedding": batch.column(1),
                }
            )
            table = distinct(table).combine_chunks()
            for size, places in by_size(table.column("embedding").combine_chunks()):
                rows = table.take(places)
                fit = fits.get(size)
                cell = np.zeros(len(rows), np.int64)
                if fit and fit.nodes:
                    x = numbers(rows.column("embedding")).reshape(-1, size)
                    cell = cells(shadows(x, fit.turn, rules), fit.nodes)
                rows = rows.add_column(0, "cell", pa.array(cell)).add_column(0, "size", pa.array(np.full(len(rows), size)))
                yield from rows.combine_chunks().to_batches()

    def pack(table: pa.Table) -> pa.Table:
        size, cell = table.column("size")[0].as_py(), table.column("cell")[0].as_py()
        fit = fits.get(size) or Fit(None, [], rules.part)
        rows = distinct(table)
        x = numbers(rows.column("embedding")).reshape(-1, size)
        points = shadows(x, fit.turn, rules)
        order = in_chunks(points)
        ids, n = (rows.column(c).to_numpy() for c in ("id", "n"))
        made = []
        for k, own in enumerate(np.array_split(order, max(1, round(len(order) / fit.rows)))):
            low, high = points[own].min(axis=0), points[own].max(axis=0)
            binary = [ids[own].tobytes(), n[own].tobytes(), x[own].tobytes()]
            made.append((size, (cell << 20) + k, *binary, low.tolist(), high.tolist()))
        columns = zip(schema.names, zip(*made, strict=True), strict=True)
        return pa.table([pa.array(list(values), schema.field(name).type) for name, values in columns], schema)

    schema = pa.schema(
        [("size", pa.int64()), ("number", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("vectors", pa.binary())]
        + [("low", pa.list_(pa.float32())), ("high", pa.list_(pa.float32()))]
    )
    kind = good.schema["embedding"].dataType.simpleString()
    dealt = good.mapInArrow(deal, f"size long, cell long, digest binary, id long, n long, embedding {kind}")
    # Twice as many tasks as cells, so that few tasks get several.
    tasks = max(1, 2 * sum(len(fit.nodes) + 1 for fit in fits.values()))
    packed = dealt.repartition(tasks, "size", "cell").groupBy("size", "cell")
    return written(
        packed.applyInArrow(
            pack, "size long, number long, ids binary, n binary, vectors binary, low array<float>, high array<float>"
        ),
        "bundles",
    )


def near_links(packed: DataFrame, kind: str, fits: dict[int, Fit], rules: VectorRules) -> DataFrame:
    """Links in each two bundles within reach: per vector that has some, their number and the smallest place of its group."""
    a, b = packed.alias("a"), packed.alias("b")
    over, under = (F.zip_with(f"{x}.low", f"{y}.high", lambda low, high: low - high) for x, y in ("ab", "ba"))
    gaps = F.zip_with(over, under, lambda x, y: F.greatest(x, y, F.lit(0.0)))
    square = F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)
    meet = F.expr("a.size = b.size AND a.number <= b.number") & (square <= reach(rules))
    # Not a shuffle: each task reads its bundles of both sides.
    tiles = a.hint("shuffle_replicate_nl").join(b, meet)
    sides = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in ("number", "ids", "n", "vectors")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple[int, int], Bundle]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                size, *both = (column[row] for column in batch.columns)
                size, own = size.as_py(), []
                fit = fits.get(size)
                for side, (number, *columns) in (("a", both[:4]), ("b", both[4:])):
                    key = (size, number.as_py())
                    if side not in known or known[side][0] != key:
                        known[side] = key, Bundle.of(columns, size, kind, fit.turn if fit else None, rules)
                    own.append(known[side])
                found = tile_links(own[0][1], None if own[0][0] == own[1][0] else own[1][1], rules)
                yield from found.to_batches()

    return tiles.select(F.col("a.size").alias("size"), *sides).mapInArrow(run, "id long, links long, root long")


def reach(rules: VectorRules) -> float:
    """The squared distance that two shadows may have."""
    return 2 - 2 * rules.cosine + 2 * COARSE_SLACK


@dataclass(frozen=True)
class Bundle:
    """The vectors of a bundle, their shadows, and the range of each chunk."""

    ids: np.ndarray
    n: np.ndarray
    x: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(columns: list[pa.Scalar], size: int, kind: str, turn: np.ndarray | None, rules: VectorRules) -> Bundle:
        kinds = ("i8", "i8", kind)
        # Copies, so that the batch they came in can go.
        ids, n, x = (np.frombuffer(c.as_buffer(), k).copy() for c, k in zip(columns, kinds, strict=True))
        x = x.reshape(-1, size)
        points = shadows(x, turn, rules)
        starts = np.arange(0, len(points), CHUNK)
        low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        return Bundle(ids, n, x, points, low, high)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of each pair; a group's label is its smallest place."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]


def near_chunks(left: Bundle, right: Bundle, alone: bool, rules: VectorRules) -> Iterator[tuple[int, int, int]]:
    """Chunks of the left side by their first row, with runs of rows of the right side that are within reach."""
    for k in range(len(left.low)):
        gap = np.maximum(np.maximum(left.low[k] - right.high, right.low - left.high[k]), 0)
        near = np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= reach(rules))
        near = near[near >= k] if alone else near
        for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
            for at in range(0, len(run), COLUMNS // CHUNK):
                some = run[at : at + COLUMNS // CHUNK]
                yield k * CHUNK, int(some[0]) * CHUNK, (int(some[-1]) + 1) * CHUNK


def tile_links(left: Bundle, other: Bundle | None, rules: VectorRules) -> pa.Table:
    """Links of one tile: for each vector that has some, their number and the smallest place of its group."""
    alone, right = other is None, other or left
    ids, n = (left.ids, left.n) if alone else (np.concatenate(z) for z in ((left.ids, right.ids), (left.n, right.n)))
    shift = 0 if alone else len(left.ids)
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    least = np.float32(rules.cosine - COARSE_SLACK)
    for first, start, end in near_chunks(left, right, alone, rules):
        near = left.points[first : first + CHUNK] @ right.points[start:end].T >= least
        if not near.any():
            continue
        i, j = linked(left.x[first : first + CHUNK], right.x[start:end], near, rules)
        i, j = i + first, j + start + shift
        if alone:
            i, j = i[i < j], j[i < j]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        label = merged(label, i, j)
    some = np.flatnonzero(links > 0)
    return pa.table({"id": ids[some], "links": links[some], "root": ids[label[some]]})


def linked(x: np.ndarray, y: np.ndarray, near: np.ndarray, rules: VectorRules) -> tuple[np.ndarray, np.ndarray]:
    """The pairs with enough cosine among those that are `near`."""
    if np.count_nonzero(near) > near.size >> 6:  # all at once costs less than one by one
        return np.nonzero(near & (unit(x) @ unit(y).T >= rules.cosine))
    i, j = np.nonzero(near)
    good = np.einsum("ij,ij->i", unit(x[i]), unit(y[j])) >= rules.cosine
    return i[good], j[good]


def near_vectors(vectors: DataFrame, rules: VectorRules | None = None) -> DataFrame:
    """`vec_id`, number of direct links, smallest id reachable by links, and whether that is its own."""
    rules = rules or VectorRules()
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    embedding = F.col("embedding") if kind == "f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding"))
    good = rows.where(valid("embedding") & F.col("vec_id").isNotNull())
    rest = rows.where(~(valid("embedding") & F.col("vec_id").isNotNull()))
    total = rows.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)))).first()[0] or 0
    fits = fitted(good, total, rules)
    found = written(near_links(bundles(good, fits, rules), kind, fits, rules), "tiles")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), digests(batch.column(1))], ["vec_id", "digest"])

    # Classes are joined by their digests, so that vectors are not shuffled again.
    named = written(good.mapInArrow(names, "vec_id long, digest binary"), "names")
    classes = (
        named.groupBy("digest")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
        .join(links, "id", "left")
        .join(groups, F.col("id") == groups["node"], "left")
        .select(
            "digest",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    kept = F.col("vec_id") == F.col("component_id")
    joined = named.join(classes, "digest").select("vec_id", "n_links", "component_id")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).select("*", F.coalesce(kept, F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
