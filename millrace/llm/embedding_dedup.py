"""Near-duplicate vectors by exact comparison in cells.

The vectors of a label are cut into cells, boxes in the leading principal coordinates of a sample. Each vector is compared with all of its
own cell and visits the cells of lower number whose box lies within the distance that a link allows; no other cell can hold a link of it.
So each pair that could be a link is compared once, whatever the size or density of a label; the sample only decides how much is
compared. Equal vectors are one row with a count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import spread
from millrace.llm.spread import connected_components, settle

#: Vectors that a cell should hold, coordinates that boxes have, bytes of vectors sampled, and products held at once.
LEAF, AXES, SAMPLE_BYTES, PRODUCTS = 4096, 16, 64 << 20, 1 << 22


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1)[:, None]


def matrix(column, dim: int) -> np.ndarray:
    return spread.packed(column, np.float32)[0].reshape(-1, dim)


def packed_vectors(batches):
    """(vec_id, label, embedding) -> (vec_id, label, dim, v): vectors that can be compared, as packed floats."""
    for b in batches:
        keep, dims, packed = [], [], []
        for i, x in enumerate(b.column(2)):
            if x.is_valid and b.column(0)[i].is_valid and b.column(1)[i].is_valid and x.values is not None and len(x.values) and not x.values.null_count:
                v = np.asarray(x.values, np.float32)
                if np.isfinite(v).all() and v.any():
                    keep.append(i)
                    dims.append(len(v))
                    packed.append((v + np.float32(0)).tobytes())  # -0.0 becomes 0.0, as equal vectors must be equal bytes
        rows = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "label", "dim", "v"])


def boxes(x: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """About ``n`` boxes (lo, hi] that divide the one given, with about as many of the points ``x`` in each. Where points can't be told
    apart, the same box several times, one after another."""
    if n <= 1:
        return [(lo, hi)]
    if len(x) < 2:
        return [(lo, hi)] * n
    axis = int(np.argmax(x.var(axis=0)))
    at = np.median(x[:, axis])
    left = x[:, axis] <= at
    if left.all() or np.ptp(x[:, axis]) < 1e-6:
        return [(lo, hi)] * n
    k = min(max(round(n * left.mean()), 1), n - 1)
    top, bottom = hi.copy(), lo.copy()
    top[axis] = bottom[axis] = at
    return boxes(x[left], k, lo, top) + boxes(x[~left], n - k, bottom, hi)


def cell_maps(reps: DataFrame, leaf: int) -> dict:
    """(label, dim) -> (axes, lo, hi) for each label of more than ``leaf`` vectors."""
    sizes = {(r.label, r.dim): r.n for r in reps.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > leaf).collect()}
    if not sizes:
        return {}
    share = min(1.0, SAMPLE_BYTES / sum(4 * dim * n for (_, dim), n in sizes.items()))
    sized = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("label", "dim")
    drawn = {k: [] for k in sizes}
    for r in reps.join(sized, ["label", "dim"]).where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))).select("label", "dim", "v").toLocalIterator():
        drawn[r.label, r.dim].append(bytes(r.v))
    out = {}
    for (label, dim), raw in drawn.items():
        x = unit(np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)) if raw else np.zeros((0, dim))
        axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))[1][:, ::-1][:, :AXES]
        k = axes.shape[1]
        lo, hi = zip(*boxes(x @ axes, -(-sizes[label, dim] // leaf), np.full(k, -np.inf), np.full(k, np.inf)), strict=True)
        out[label, dim] = (axes, np.array(lo), np.array(hi))
    return out


DEALT = "label string, dim int, __cell int, __visits boolean, rep long, n long, v binary"


def deal(maps: dict, least: float):
    """(label, dim, rep, n, v) -> each vector in its own cell, and as a visitor in lower cells that may hold links of it."""
    far = 2 - 2 * least + 1e-6  # squared distance of unit vectors; rounding stays far below the margin

    def step(batches):
        for b in batches:
            labels, dims, rep = b.column(0).to_pylist(), b.column(1).to_pylist(), np.asarray(b.column(2))
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                rows = np.array(rows)
                if key not in maps:
                    parts = [(rows, np.zeros(len(rows), np.int32), np.zeros(len(rows), bool))]
                else:
                    parts = placed(*maps[key], unit(matrix(b.column(4).take(pa.array(rows)), key[1])), rows, rep)
                for at, cell, visits in parts:
                    r = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(cell, pa.int32()), pa.array(visits), r.column(2), r.column(3), r.column(4)], names=["label", "dim", "__cell", "__visits", "rep", "n", "v"])

    def placed(axes, lo, hi, u, rows, rep):
        x = u @ axes
        each = max(1, PRODUCTS // 4 // len(lo))
        for a in range(0, len(x), each):
            part, ids = x[a : a + each], rows[a : a + each]
            inside, gap = np.ones((len(part), len(lo)), bool), np.zeros((len(part), len(lo)))
            for k in range(part.shape[1]):
                p = part[:, k, None]
                inside &= (lo[:, k] < p) & (p <= hi[:, k])
                gap += np.maximum(np.maximum(lo[:, k] - p, p - hi[:, k]), 0) ** 2
            own = np.argmax(inside, axis=1) + np.abs(rep[ids]) % inside.sum(axis=1)  # equal boxes stand together
            near = (gap <= far) & (np.arange(len(lo)) < own[:, None])
            yield ids, own.astype(np.int32), np.zeros(len(ids), bool)
            for c in range(0, len(ids), 1024):
                at, cell = np.nonzero(near[c : c + 1024])
                for d in range(0, len(at), 8192):
                    yield ids[c + at[d : d + 8192]], cell[d : d + 8192].astype(np.int32), np.ones(len(at[d : d + 8192]), bool)

    return step


def compare(own: np.ndarray, n_own: int, v: np.ndarray, n: np.ndarray, least: float):
    """Of a cell whose first ``n_own`` rows are its own (as unit vectors) and the others visitors: each row's links, and the smallest row it
    is joined with. Products in single precision; those that it can't decide are taken again in double precision."""
    total, label, margin = np.zeros(len(v), np.int64), np.arange(len(v)), (v.shape[1] + 4) * 1.2e-7
    single = own.astype(np.float32)
    each = max(1, min(1024, PRODUCTS // max(n_own, 1)))
    for a, b in [*((a, min(a + each, n_own)) for a in range(0, n_own, each)), *((a, min(a + each, len(v))) for a in range(n_own, len(v), each))]:
        u = unit(v[a:b])
        from_ = a if a < n_own else 0
        g = u.astype(np.float32) @ single[from_:].T
        i, j = np.divmod(np.flatnonzero(g >= least - margin), g.shape[1])
        score = g[i, j]
        j += from_
        once = (i + a >= n_own) | (j > i + a)
        i, j, score = i[once], j[once], score[once]
        keep = np.ones(len(i), bool)
        unsure = np.flatnonzero(score <= least + margin)
        for c in range(0, len(unsure), 65536):
            at = unsure[c : c + 65536]
            keep[at] = np.einsum("ij,ij->i", u[i[at]], own[j[at]]) >= least
        i, j = i[keep] + a, j[keep]
        if len(i):
            total += np.bincount(i, n[j], len(v)).astype(np.int64) + np.bincount(j, n[i], len(v)).astype(np.int64)
            low, high = label[i], label[j]
            new = low != high
            if new.any():
                label = spread.union_find(len(v), low[new], high[new])[label]
    return total, label


def compare_cells(least: float):
    """A partition sorted by cell, own vectors first -> (a, b, n_links): links that join what is joined (n_links null), and links
    counted in the cell (b null)."""
    keys = ["label", "dim", "__cell"]

    def step(batches):
        for table in spread.streamed_groups(batches, keys):
            bounds = spread.group_bounds(table, keys)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                rows = table.slice(lo, hi - lo)
                v = matrix(rows.column("v"), rows.column("dim")[0].as_py())
                ids, n = np.asarray(rows.column("rep")), np.asarray(rows.column("n"))
                n_own = int(np.sum(~np.asarray(rows.column("__visits"))))
                if not n_own:
                    continue
                total, label = compare(unit(v[:n_own]), n_own, v, n, least)
                far, told = np.flatnonzero(label != np.arange(len(v))), np.flatnonzero(total)
                null = lambda k: pa.nulls(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[label[far]]), pa.array(ids[far]), null(len(far))], names=["a", "b", "n_links"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[told]), null(len(told)), pa.array(total[told])], names=["a", "b", "n_links"])

    return step


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", least: float = 0.98, leaf: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row: links have cosine >= ``least`` in double precision and equal labels.

    Null, empty, zero or non-finite vectors, vectors of other dimensions and null labels or ids link with nothing (component: its own
    id; kept). Repeated rows, with the same id or not, are vectors of their own and count as links of each other. No rows give no rows.

    Every link is found. Pairs in cells too far apart for a link are not compared; how many that spares depends on the data, and a label
    whose vectors all lie close together is compared whole.
    """
    leaf = leaf or LEAF
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>").alias("embedding"))
    usable = base.mapInArrow(packed_vectors, "vec_id long, label string, dim int, v binary")
    usable = settle(usable)
    classes = settle(usable.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    maps = cell_maps(classes.select("label", "dim", "v"), leaf)
    dealt = classes.select("label", "dim", "rep", "n", "v").mapInArrow(deal(maps, least), DEALT)
    dealt = dealt.repartition(parts, "label", "dim", "__cell").sortWithinPartitions("label", "dim", "__cell", "__visits")
    found = settle(dealt.mapInArrow(spread.rows_giving_back(compare_cells(least)), "a long, b long, n_links long"))
    groups = settle(connected_components(found.where("b IS NOT NULL").select("a", "b")))
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n_links").alias("__links"))
    told = classes.select("label", "dim", "v", "rep", "n").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").join(counted.withColumnRenamed("vec_id", "rep"), "rep", "left")
    told = told.select("label", "dim", "v", (F.col("n") - 1 + F.coalesce("__links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    own = usable.join(told, ["label", "dim", "v"]).select("vec_id", "n_links", "component_id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = base.select("vec_id").join(own, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
