"""Near-duplicate vectors by int8 tile products with error bounds.

Equal vectors are one class.  Classes are dealt into tiles by their nearest
pivot; a vector goes to another tile only if the plane between the two pivots
does not rule out every link (distances obey the triangle inequality).  What
is sent are int8 codes with each vector's scale and the exact length of its
rounding residue: where two tiles meet, the product of codes comes with a bound
on the error of each pair, and only vectors of pairs that might reach the
threshold are sent once more, in full, to be computed in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_number, tidy
from tessera.llm.simhash import _forest
from tessera.operators.components import components, cut

#: Least number of tiles, and most vectors of one.  Every vector is sent to
#: each tile at most, so copies do not grow below LEAST x TILE vectors.
LEAST, TILE = 8, 131_072
#: Vectors that pivots are chosen from, at most; any choice gives the same links.
SAMPLE = 4096


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the lengths of the residues of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    code = np.rint(x / scale[:, None])
    return code.astype(np.int8), scale, np.sqrt(((x - code * scale[:, None]) ** 2).sum(axis=1))


def reach(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """True wherever two quantised unit vectors might have that cosine: x.y
    differs from the codes' product by at most |rx| + |ry| + |rx||ry|."""
    (qa, sa, ra), (qb, sb, rb) = a, b
    exact = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qa.astype(exact) @ qb.astype(exact).T) * (sa[:, None] * sb[None, :])
    return product + (ra[:, None] + rb[None, :] + ra[:, None] * rb[None, :] + 1e-9) >= threshold


def possible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The same for unit vectors."""
    return reach(quantise(a), quantise(b), threshold)


def _units(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # against overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _meet(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        rep, w, x = t.column("rep").to_numpy(), t.column("w").to_numpy(), _units(t.column("v"))
        own = t.column("own")[0].as_py()
        at = np.flatnonzero(side == 0)
        bt = at if own else np.flatnonzero(side == 1)
        count = np.zeros(len(rep), np.int64)
        ea, eb = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for p in range(0, len(at), 512):
            a = at[p : p + 512]
            for q in range(p if own else 0, len(bt), 2048):
                b = bt[q : q + 2048]
                i, j = np.nonzero(possible(x[a], x[b], threshold))
                if own:
                    later = p + i < q + j
                    i, j = i[later], j[later]
                for k in range(0, len(i), 100_000):
                    y, z = a[i[k : k + 100_000]], b[j[k : k + 100_000]]
                    good = np.einsum("nd,nd->n", x[y], x[z]) >= threshold
                    y, z = y[good], z[good]
                    if len(y):
                        np.add.at(count, y, w[z])
                        np.add.at(count, z, w[y])
                        ea, eb = _forest(np.concatenate([ea, rep[y]]), np.concatenate([eb, rep[z]]))
        some = np.flatnonzero(count)
        none = pa.nulls(len(some), pa.int64())
        return pa.table({"a": pa.array(np.concatenate([rep[some], ea])), "b": pa.concat_arrays([none, pa.array(eb, pa.int64())]), "n": pa.array(np.concatenate([count[some], np.zeros(len(ea), np.int64)]))})

    return run


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different lengths with each other.
    Equal vectors are linked.  Ids are of any type that has an order.  Rows with a null id count as no vector: no
    links, null component, not kept.  Repeated ids are vectors of their own.
    """
    rows = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return by_number(rows, "vec_id", lambda rows: _near(rows, threshold))


def _near(rows: DataFrame, threshold: float) -> DataFrame:
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("bigint"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(fit, F.col("v")))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w")))
    found = None
    for r in classes.groupBy(F.size("v").alias("dim")).count().collect():  # a row for each length of vector
        one = _found(classes.where(F.size("v") == r["dim"]), r["dim"], r["count"], threshold)
        found = one if found is None else found.union(one)
    alone = [F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")]
    if found is None:
        return rows.select("vec_id", *alone)
    found = cut(found)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    of = components(found.where("b is not null"), "a", "b")
    done = classes.join(counts, classes.rep == counts.a, "left").join(of, classes.rep == of.node, "left")
    done = done.select("v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("v is not null").join(done, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.union(rows.where("v is null").select("vec_id", *alone))


def _pivots(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit vectors in the middle of groups of the sample: farthest first,
    then moved to their groups' means."""
    at = [0]
    near = x @ x[0]
    for _ in range(min(k, len(x)) - 1):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    p = x[at]
    for _ in range(rounds):
        own = (x @ p.T).argmax(axis=1)
        mean = np.zeros_like(p)
        np.add.at(mean, own, x)
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        p = np.where(size > 1e-6, mean / np.maximum(size, 1e-6), p)
    return p


def _candidates(threshold: float, dim: int):
    """Vectors of a pair of tiles that might have a link there."""

    def run(t: pa.Table) -> pa.Table:
        side, rep = t.column("side").to_numpy(), t.column("rep").to_numpy()
        raw = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(rep), dim + 16)
        code, rest = raw[:, :dim].view(np.int8), np.ascontiguousarray(raw[:, dim:]).view("<f8")
        pick = lambda k: (code[k], rest[k, 0], rest[k, 1])
        own = t.column("own")[0].as_py()
        at = np.flatnonzero(side == 0)
        bt = at if own else np.flatnonzero(side == 1)
        found = np.zeros(len(rep), bool)
        for p in range(0, len(at), 1024):
            a = at[p : p + 1024]
            for q in range(p if own else 0, len(bt), 4096):
                b = bt[q : q + 4096]
                i, j = np.nonzero(reach(pick(a), pick(b), threshold))
                if own:
                    other = p + i != q + j
                    i, j = i[other], j[other]
                found[a[i]] = found[b[j]] = True
        some = np.flatnonzero(found)
        keep = pa.array(some)
        return pa.table({"m": t.column("m").take(keep), "own": t.column("own").take(keep), "side": t.column("side").take(keep), "rep": t.column("rep").take(keep)})

    return run


def _found(classes: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """Link counts (``a, null, n``) and enough links (``a, b, 0``) to give
    the components of all."""
    spark = classes.sparkSession
    tiles = max(min(LEAST, n), -(-n // TILE))
    some = classes.select("v", "rep").orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    pivots = _pivots(_units(some.column("v")), min(tiles, 1024))
    shared = spark.sparkContext.broadcast(pivots)  # at most 1024 x dim numbers

    def nearest(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array((_units(b.column(0)) @ shared.value.T).argmax(axis=1).astype(np.int32))], names=["rep", "cell"])

    of = cut(classes.select("v", "rep").mapInArrow(tidy(nearest), "rep bigint, cell int"))
    size = np.zeros(len(pivots), np.int64)
    for r in of.groupBy("cell").count().collect():  # a row a pivot
        size[r.cell] = r["count"]
    # A cell with many vectors is several tiles, all of which meet.
    parts = np.maximum(1, -(-size // max(1, -(-n // tiles))))
    first = np.concatenate([[0], np.cumsum(parts)])
    total = int(first[-1])
    cell_of = np.repeat(np.arange(len(parts)), parts)
    far = np.sqrt(2 - 2 * threshold) + 1e-9
    plan = spark.sparkContext.broadcast((parts, first, cell_of, np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))))

    def deal(batches):
        parts, first, cell_of, gap = plan.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                b = batch.slice(start, 2000)
                x, rep = _units(b.column(0)), b.column(1).to_numpy()
                code, scale, residue = quantise(x)
                packed = np.concatenate([code.view(np.uint8), np.stack([scale, residue], axis=1).astype("<f8").view(np.uint8)], axis=1)
                near = x @ shared.value.T
                cell = near.argmax(axis=1)
                own = first[cell] + (rep * 2654435761 >> 16) % parts[cell]
                # x is at least so far from all that is nearer to the other pivot.
                may = near[np.arange(len(x)), cell][:, None] - near <= far * gap[cell]
                i, tile = np.nonzero(may[:, cell_of])
                mine = own[i]
                low, high = np.minimum(mine, tile), np.maximum(mine, tile)
                flat = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(np.arange(0, (len(i) + 1) * packed.shape[1], packed.shape[1], dtype=np.int32).tobytes()), pa.py_buffer(packed[i].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(low * len(cell_of) + high), pa.array(low == high), pa.array((mine != low).astype(np.int8)), pa.array(rep[i]), flat], names=["m", "own", "side", "rep", "code"])

    pairs = min(10_000, total * (total + 1) // 2)
    dealt = classes.select("v", "rep").mapInArrow(tidy(deal), "m bigint, own boolean, side tinyint, rep bigint, code binary").repartition(pairs, "m")
    near = dealt.groupBy("m").applyInArrow(_candidates(threshold, dim), "m bigint, own boolean, side tinyint, rep bigint")
    full = cut(near).join(classes.select("v", "rep", "w"), "rep")
    return full.groupBy("m").applyInArrow(_meet(threshold), "a bigint, b bigint, n bigint")
