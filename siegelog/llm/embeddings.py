"""Near duplicates of embeddings: all pairs in PCA-ordered tiles.

The vectors, scaled to length 1, are turned to their principal axes, which
keeps every product and puts most of it into the leading dimensions. The
covariance is summed over all rows; only its dims x dims sum reaches the driver.

Vectors are sorted along the first axis into tiles. Two of length 1 with cosine c
are sqrt(2 - 2 c) apart at most, so tiles further apart are never
compared. A pair of tiles is one matrix product in single precision, over the leading
dimensions and the norm of the rest: the rest of a product is at most the product of the two
norms (Cauchy-Schwarz), so a pair whose sum is below the threshold, by more than rounding can
take, stops there. Where too many pairs are left, the product is made again with twice the
dimensions. What is left is decided by the cosine of the given vectors in double precision,
but for products of all dimensions that are above the threshold by more than rounding.

All pairs of tiles in reach are compared, so the work is quadratic where one axis rules
out little; a task holds two tiles, and of their links only a forest.

Equal vectors are one representative from the start and link among themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siegelog.llm.components import components
from siegelog.llm.storage import ship, stored

# Representatives in a tile, about, and bytes of their vectors.
TILE = 16384
TILE_BYTES = 24 << 20
# Products that are held at a time.
CELLS = 1 << 22
# Leading dimensions of the first product; more while over one pair in FEW is left.
LEADING = 16
FEW = 256
# Pairs that are decided at a time.
DECIDED = 1 << 16
# Rounding of the turned, scaled products in double precision.
MARGIN = 1e-9


def _valid(batches) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; without those that are null, empty, zero or not finite."""
    for batch in batches:
        ids, bodies, sizes = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
            if v and None not in v:
                a = np.array(v, np.float64) + 0.0  # no negative zeros
                largest = np.abs(a).max()
                if np.isfinite(a).all() and largest > 0:
                    ids.append(i)
                    bodies.append(a.tobytes())
                    sizes.append(len(a))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary()), pa.array(sizes, pa.int32())], ["id", "body", "dims"])


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _unit(a: np.ndarray) -> np.ndarray:
    a = a / np.abs(a).max(axis=1, keepdims=True)  # no overflow of squares
    return a / np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]


def _covariance(batches) -> Iterator[pa.RecordBatch]:
    total, rows = 0, 0
    for batch in batches:
        if batch.num_rows:
            u = _unit(_matrix(batch.column("body")))
            total, rows = total + u.T @ u, rows + len(u)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])


def _turned(axes):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = _unit(_matrix(batch.column("body"))) @ axes.value[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), batch.column("body"), pa.array(first)], ["rep", "copies", "body", "first"])

    return run


def _margin(dims: int) -> float:
    """What rounding to single precision can add to or take from a product of vectors of length 1, and more."""
    return MARGIN + (dims + 8) * 2.0**-23


def _shortened(turned: np.ndarray, k: int) -> np.ndarray:
    """The leading k dimensions and the norm of the others: a product of two such rows is never below that of the whole ones."""
    rest = turned[:, k:]
    return np.column_stack([turned[:, :k], np.sqrt(np.einsum("ij,ij->i", rest, rest))]).astype(np.float32)


def _candidates(turned: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows a and b of pairs whose product may reach the threshold, and whether it surely does. Each pair once if left is right."""
    dims = turned.shape[1]
    margin, own = _margin(dims), left is right
    k = min(LEADING, dims)
    u = _shortened(turned[left], k)
    v = u if own else _shortened(turned[right], k)
    at = 0
    while at < len(left):
        among = right[at:] if own else right
        rows = left[at : at + max(1, CELLS // len(among))]
        while True:
            bound = (u[at : at + len(rows)] @ v[len(right) - len(among) :].T).ravel()
            hits = np.flatnonzero(bound >= threshold - margin)
            if k == dims or len(hits) * FEW <= len(bound):
                break
            k = min(2 * k, dims)
            u = _shortened(turned[left], k)
            v = u if own else _shortened(turned[right], k)
        for s in range(0, len(hits), DECIDED):
            hit = hits[s : s + DECIDED]
            i, j = np.divmod(hit, len(among))
            sure = bound[hit] >= threshold + margin if k == dims else np.zeros(len(hit), bool)
            if own:
                once = i < j
                i, j, sure = i[once], j[once], sure[once]
            yield rows[i], among[j], sure
        at += len(rows)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, largest components from 0.5 to 1: squares neither overflow nor vanish, cosines stay exactly."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -exponent[:, None])


def _compared(axes, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        tile = table.column("tile").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        given = _scaled(_matrix(table.column("body")))
        norm = np.sqrt(np.einsum("ij,ij->i", given, given))
        left = np.flatnonzero(tile == low)
        right = left if low == high else np.flatnonzero(tile == high)
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        forest = []
        for x, y, linked in _candidates(_unit(given) @ axes.value, left, right, threshold):
            open_ = np.flatnonzero(~linked)
            a, b = x[open_], y[open_]
            linked[open_] = np.einsum("ij,ij->i", given[a], given[b]) / (norm[a] * norm[b]) >= threshold
            x, y = x[linked], y[linked]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            *joined, label = _forest(x, y, label)
            forest.append(joined)
        tree = [np.concatenate(p) for p in zip(*forest, strict=True)] if forest else [np.zeros(0, int)] * 2
        some = np.flatnonzero(links)
        out_a = np.concatenate([rep[some], rep[tree[0]]])
        out_b = np.concatenate([np.full(len(some), -1), rep[tree[1]]])
        count = np.concatenate([links[some], np.zeros(len(tree[0]), np.int64)])
        is_link = np.concatenate([np.zeros(len(some), bool), np.ones(len(tree[0]), bool)])
        return pa.table([pa.array(out_a), pa.array(out_b), pa.array(count), pa.array(is_link)], ["a", "b", "links", "edge"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a-b that join what ``label`` keeps apart, and the new labels: in rounds, one link from each component to a smaller one."""
    out_a, out_b = [np.zeros(0, int)], [np.zeros(0, int)]
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        out_a.append(a[first])
        out_b.append(b[first])
        parent = np.arange(len(label))
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(out_a), np.concatenate(out_b), label


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id`` and ``kept`` for each row.

    Rows link if the cosine of their vectors is at least ``threshold``, which is over 0.
    A component is named by the smallest id that links reach; ``kept`` marks it.
    Vectors that are null, empty or zero, or hold nulls or non-finite numbers, link with nothing;
    vectors of different lengths never link. Rows that share an id are counted each, a
    null id links with nothing and its row has no component.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    valid = rows.filter("id is not null").mapInArrow(_valid, "id long, body binary, dims int")
    valid = stored(valid, "vectors")
    classes = stored(
        valid.groupBy("body", "dims")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    found = [_one_length(classes.filter(F.col("dims") == d[0]), threshold) for d in classes.select("dims").distinct().collect()]
    answer = rows.select("id")
    if not found:
        return answer.select(
            F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
        )
    compared = found[0]
    for more in found[1:]:
        compared = compared.union(more)
    compared = stored(compared, "compared")
    groups = components(compared.filter("edge").select("a", "b")).toDF("rep", "component")
    others = compared.filter("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("others"))
    named = classes.join(groups, "rep", "left").join(others, "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    smallest = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "group").select(
        "body", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = valid.join(named, "body").select("id", "n_links", "component_id")
    # An id may come more than once, with a vector or without: the ones without are added by number.
    alone = rows.filter("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    missing = (
        rows.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
        .join(valid.groupBy("id").agg(F.count("*").alias("v")), "id", "left")
        .withColumn("n", F.col("n") - F.coalesce("v", F.lit(0)))
        .filter("n > 0")
        .select("id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
        .select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    )
    answer = linked.union(missing).union(alone)
    return answer.select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def _one_length(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links, edge): links of representatives to others, and a forest of them."""
    spark = classes.sparkSession
    sums = classes.mapInArrow(_covariance, "sums array<double>")
    total = sums.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("x")).orderBy("pos").collect()  # dims x dims numbers
    dims = math.isqrt(len(total))
    _, axes = np.linalg.eigh(np.array([r["x"] for r in total]).reshape(dims, dims))
    axes = spark.sparkContext.broadcast(np.ascontiguousarray(axes[:, ::-1]))
    turned = stored(classes.select("rep", "copies", "body").mapInArrow(_turned(axes), "rep long, copies long, body binary, first double"), "turned")

    count = turned.count()
    size = max(1, min(TILE, TILE_BYTES // (8 * dims)))
    tiles = max(1, math.ceil(count / size))
    # Tiles of equal size along the first axis: limits from quantiles, a list as long as the number of tiles.
    limits = sorted(set(turned.approxQuantile("first", [k / tiles for k in range(1, tiles)], 0.1 / tiles))) if tiles > 1 else []
    dealt, parts = _dealt(turned, limits, size)
    # The last part that one of a part's vectors can reach; beyond it no cosine gets to the threshold.
    reach = math.sqrt(2 - 2 * threshold) + MARGIN
    until = [int(np.searchsorted(limits, x + reach, "right")) for x in limits] + [len(limits)]
    reached = spark.createDataFrame(list(enumerate(until)), "part int, until int")
    last = parts.select(F.col("part").alias("until"), (F.col("start") + F.col("pieces") - 1).alias("last"))
    pairs = (
        parts.join(reached, "part")
        .join(last, "until")
        .select(F.explode(F.sequence("start", F.col("start") + F.col("pieces") - 1)).alias("low"), "last")
        .select("low", F.explode(F.sequence("low", "last")).alias("high"))
    )
    work = dealt.join(pairs.withColumn("tile", F.explode(F.array_distinct(F.array("low", "high")))), "tile")
    return work.select("low", "high", "tile", "rep", "copies", "body").groupBy("low", "high").applyInArrow(
        _compared(axes, threshold), "a long, b long, links long, edge boolean"
    )


def _dealt(turned: DataFrame, limits: list[float], size: int) -> tuple[DataFrame, DataFrame]:
    """Vectors with their tile, and the parts between ``limits`` with their first tile and number of tiles.

    A part that came out larger than others, as values along the axis may be
    equal, is split by a hash.
    """
    bounds = turned.sparkSession.sparkContext.broadcast(np.array(limits))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds.value, batch.column("first").to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "part"])

    placed = turned.mapInArrow(run, "rep long, copies long, body binary, first double, part int")
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / (2 * size)).alias("pieces"))
    every = turned.sparkSession.createDataFrame([(k,) for k in range(len(limits) + 1)], "part int")  # also the empty ones
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = every.join(sizes, "part", "left").select("part", F.coalesce("pieces", F.lit(1)).alias("pieces"))
    parts = parts.withColumn("start", F.coalesce(F.sum("pieces").over(before), F.lit(0)))
    dealt = placed.join(parts, "part").withColumn("tile", F.col("start") + F.pmod(F.xxhash64("rep"), "pieces"))
    return dealt.select("rep", "copies", "body", "tile"), parts
