"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of the fingerprints are grouped by correlation into partitions; the
partitions get thresholds that may differ, add up to ``max_bits`` less the
number of partitions plus one, and are chosen by dynamic programming on
estimated candidate counts.  Two fingerprints within ``max_bits`` then agree
within the threshold on at least one partition: each probes the keys near
its own there, and candidates are verified on all 64 bits.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_number, map_texts, tidy
from tessera.operators.components import components, cut

#: Rows of one probe key above which the key is dealt out in pairs of tiles.
TILE = 4096
#: Comparisons of two fingerprints (nanoseconds, vectorised) that cost as
#: much as one probe row (made, shuffled and sorted).
PROBE = 500


def _fingerprint(text: str, width: int) -> int:
    """As a signed 64-bit number; zero if the text has no words."""
    import xxhash

    # Bytes: lower() changes A-Z only, split() parts at 0x20 and 0x09-0x0D.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= width:
        h = [hash_(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        stops = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *stops]
        h = [hash_(line[a : b - 1], 42) for a, b in zip(starts, stops[width - 1 :])]
    bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_ = 2 * bits.sum(axis=0, dtype=np.int64) > len(h)
    return int(np.packbits(set_, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3) -> DataFrame:
    """``keep`` and ``fp bigint`` for every whole text: a bit is set if it is
    set in over half of the XXH64 hashes (seed 42) of the ``width``-word
    shingles, repeats included.  Null and empty texts give zero."""

    def run(_, texts: list[str]) -> list:
        return [pa.array([_fingerprint(t, width) for t in texts], pa.int64())]

    kept = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in keep)
    return map_texts(df, text, f"{kept}, fp bigint", run, list(keep))


def correlated(prints: DataFrame, parts: int, both: np.ndarray, n: int) -> list[list[int]]:
    """64 bits in ``parts`` groups of like size, correlated bits together.
    ``both[i, j]``: fingerprints with bits i and j set."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: corr[b, group].sum())
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def _together(prints: DataFrame) -> np.ndarray:
    """How often each two bits are set together, over all fingerprints."""

    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            for at in range(0, len(fp), 1 << 15):
                bits = np.unpackbits(fp[at : at + (1 << 15)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["at", "n"])

    out = np.zeros(4096)
    for r in prints.select("fp").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 4,096 rows
        out[r.at] = r.n
    return out.reshape(64, 64)


def allocate(groups: list[list[int]], pairs: list[float], n: int, max_bits: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) of the least estimated cost, by dynamic
    programming over the partitions and the sum of thresholds so far.

    ``pairs``: equal pairs in each partition, counted over all rows.  Pairs
    that differ are estimated as spread evenly over the keys.  A probe key
    costs as much as PROBE candidates.
    """
    def cost(i: int, t: int) -> float:
        width = len(groups[i])
        near = sum(comb(width, d) for d in range(t + 1))
        return (pairs[i] + n * n / 2 * (near - 1) / 2**width + PROBE * n * near) if t >= 0 else 0.0

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(len(groups)):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, ts) in best.items():
            for t in range(-1, max_bits + 1):
                if t <= len(groups[i]):
                    got = (c + cost(i, t), ts + [t])
                    if total + t not in step or got < step[total + t]:
                        step[total + t] = got
        best = step
    return best[max_bits - len(groups) + 1]


def plan(prints: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """Partitions and thresholds for these fingerprints, from statistics
    over all of them; the number of partitions is part of the choice."""
    n = max(1, prints.count())  # without rows, too, fewer probe keys are better
    both = _together(prints)
    options = [correlated(prints, m, both, n) for m in range(2, max_bits + 2)] if max_bits else [[list(range(64))]]
    keys = [_key(F.col("fp"), g) for groups in options for g in groups]
    cells = prints.select(F.posexplode(F.array(*keys))).groupBy("pos", "col").count()
    count = {r.pos: r.pairs for r in cells.groupBy("pos").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}  # a row a partition
    best, at = None, 0
    for groups in options:
        pairs = [count.get(at + i, 0.0) for i in range(len(groups))]
        at += len(groups)
        cost, ts = allocate(groups, pairs, n, max_bits)
        if best is None or cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, ts) if t >= 0]
    return best[1]


def _key(fp, bits: list[int]):
    """The fingerprint with only these bits."""
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _masks(bits: list[int], t: int) -> list[int]:
    out = [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(bits, d)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars with the same components as a list of edges."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links(at: np.ndarray, fp: np.ndarray, rep: np.ndarray, base: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows whose group numbers ``at`` are sorted."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(at))
    d = 1
    while True:
        rows = rows[rows < len(at) - d]
        rows = rows[at[rows] == at[rows + d]]
        if not len(rows):
            break
        x, y = rows, rows + d
        good = (base[x] | base[y]) & (rep[x] != rep[y]) & (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= max_bits)
        if good.any():
            found.append((rep[x[good]], rep[y[good]]))
            if sum(len(a) for a, _ in found) > 500_000:
                found = [_forest(*map(np.concatenate, zip(*found)))]
        d += 1
    if not found:
        return rep[:0], rep[:0]
    return _forest(*map(np.concatenate, zip(*found)))


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """``a, b``: links between the ``rep`` of distinct fingerprints ``fp``.
    Not all pairs, but a set with the same components: no link is lost."""
    chosen = plan(prints, max_bits)
    probes = [F.struct(F.lit(i).alias("part"), _key(F.col("fp"), g).bitwiseXOR(F.lit(m)).alias("key"), F.lit(m == 0).alias("base")) for i, (g, t) in enumerate(chosen) for m in _masks(g, t)]
    rows = prints.select("fp", "rep", F.explode(F.array(*probes)).alias("p")).select("fp", "rep", "p.*")
    # Keys with many rows are dealt out: every two tiles meet in one task.
    large = rows.groupBy("part", "key").count().where(F.col("count") > TILE).select("part", "key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = rows.join(large, ["part", "key"], "left")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("tile", F.coalesce(tile, F.lit(0))).withColumn("other", other)
    rows = rows.select("part", "key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "fp", "rep", "base")

    def run(batches):
        kept: pa.Table | None = None

        def put(t: pa.Table):
            if not t.num_rows:
                return
            cols = [t.column(c).to_numpy() for c in ("part", "key", "i", "j")]
            new = np.zeros(t.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            a, b = _links(np.cumsum(new), t.column("fp").to_numpy(), t.column("rep").to_numpy(), np.asarray(t.column("base").to_numpy(), bool), max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([kept, t]) if kept is not None else t
            last = [t.column(c)[-1].as_py() for c in ("part", "key", "i", "j")]
            same = np.ones(t.num_rows, bool)
            for c, v in zip(("part", "key", "i", "j"), last):
                same &= t.column(c).to_numpy() == v
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            yield from put(t.slice(0, whole).combine_chunks())
            kept = t.slice(whole)
        if kept is not None:
            yield from put(kept.combine_chunks())

    dealt = rows.repartition("part", "key", "i", "j").sortWithinPartitions("part", "key", "i", "j")
    return dealt.mapInArrow(tidy(run), "a bigint, b bigint")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, max_bits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, keep, fp bigint, component_id``: the smallest id reachable over
    fingerprints that differ in at most ``max_bits`` bits, itself included.

    Equal fingerprints are linked (so are all null and empty texts, whose
    fingerprint is zero).  Only distinct fingerprints are compared.  Rows
    with a null id link nothing, and take the component of their
    fingerprint's other documents, else null.  Repeated rows stay.  Ids are of
    any type that has an order.
    """
    df = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *keep)
    return by_number(df, "doc_id", lambda rows: _near(rows, width, max_bits, keep))


def _near(df: DataFrame, width: int, max_bits: int, keep: tuple[str, ...]) -> DataFrame:
    prints = cut(fingerprints(df.withColumn("doc_id", F.col("doc_id").cast("bigint")), keep=("doc_id", *keep), width=width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = links(distinct.where("rep is not null"), max_bits)
    of = components(found, "a", "b")
    classes = distinct.join(of, distinct.rep == of.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", *keep, "fp", "component_id")
