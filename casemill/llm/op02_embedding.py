"""Embedding near-duplicates by random hyperplane tables whose buckets are compared whole.

* Gathering passes order the vectors of a label by 62 concatenated random hyperplane hashes: a vector within an
  eighth of the linking angle of a recent leader joins it, whatever the group's size; a group's radius is kept as
  a bound on its members' angles. Any two members are linked (triangle inequality on angles), so that a group of a
  million near copies is one row afterwards and its links are counted, not listed.
* Tables: the leaders of a label and dimension are dealt into buckets by the bits of a table, and all pairs of a
  bucket are compared, block by block where it is large. Bits and number of tables follow from the number of
  leaders, so that a pair at the threshold meets in a table with the stated recall, however dense the label is; up to
  some ten thousand leaders there is one bucket and nothing is missed. A pair counts in the first table it meets
  in, so that links are summed up where they are found and not listed either.
* The angle of two leaders and both radii decide: all members linked, none, or members to be compared. The last
  are compared block by block as matrices.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a
label, link with nothing; vectors of different dimension never link; every row is a vector of its own, also
when its id repeats; equal vectors are links like any others; an empty table returns no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm.common import cut, small_batches, table
from casemill.llm.components import components
from casemill.llm.vectors import matrix, numbered

HASHES = 62
SLACK = 1e-7  # radians, kept from every bound
#: What sending a vector to one more table costs, in comparisons of two vectors.
SENDING = 4000
#: Most bytes of vectors in a block.
BLOCK_BYTES = 1 << 21
LEADERS = "rid long, label long, dim int, unit array<double>, radius double, weight long"


def hash_keys(unit: np.ndarray, seed: int) -> np.ndarray:
    """Signs of random projections, the first the most significant."""
    planes = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], HASHES))
    return ((unit @ planes > 0).astype(np.int64) << np.arange(HASHES - 1, -1, -1, dtype=np.int64)).sum(1)


def _keyed(leaders: DataFrame, seed: int) -> DataFrame:
    """Leaders in the order of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                own = b.filter(pa.array(dims == d))
                unit = matrix(own.column("unit"))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(hash_keys(unit, seed))], names=[*own.schema.names, "key"])

    return leaders.mapInArrow(run, f"{LEADERS}, key long").repartitionByRange("label", "dim", "key", "rid").sortWithinPartitions("label", "dim", "key", "rid")


def _gather(leaders: DataFrame, seed: int, limit: float, window: int) -> DataFrame:
    """One gathering pass: leaders that stay (into null) and those that joined another (into its rid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held, at = None, [], None, 0
        for b in batches:
            out: list[list] = []
            label, dim, rid, radius, weight = (b.column(c).to_pylist() for c in ("label", "dim", "rid", "radius", "weight"))
            unit = b.column("unit")
            flat, pos = unit.flatten().to_numpy(zero_copy_only=False), 0
            for i in range(b.num_rows):
                u = flat[pos : pos + dim[i]]
                pos += dim[i]
                if (label[i], dim[i]) != group:
                    out += rows
                    group, rows, at = (label[i], dim[i]), [], 0
                    held = np.zeros((window, dim[i]))
                if rows:
                    angle = np.arccos(np.clip(held[: len(rows)] @ u, -1.0, 1.0))
                    k = int(angle.argmin())
                    if angle[k] + radius[i] <= limit - SLACK:
                        rows[k][4] = max(rows[k][4], float(angle[k]) + radius[i])
                        rows[k][5] += weight[i]
                        out.append([rid[i], label[i], dim[i], [], radius[i], weight[i], rows[k][0]])
                        continue
                row = [rid[i], label[i], dim[i], u.copy(), radius[i], weight[i], None]
                if len(rows) < window:
                    held[len(rows)] = u
                    rows.append(row)
                else:
                    out.append(rows[at])
                    rows[at], held[at] = row, u
                    at = (at + 1) % window
            if out:
                yield batch(out)
        if rows:
            yield batch(rows)

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["rid", "label", "dim", "unit", "radius", "weight", "into"])

    return _keyed(leaders, seed).drop("key").mapInArrow(run, f"{LEADERS}, into long")


def tables_for(n: int, angle: float, recall: float, sending: float = SENDING) -> tuple[int, int]:
    """Bits of a bucket and number of tables in which two of ``n`` vectors at ``angle`` meet with probability ``recall``,
    by the least cost of sending and comparing."""

    def tables(bits: int) -> int:
        return max(1, math.ceil(math.log(1 - recall) / math.log1p(-((1 - angle / math.pi) ** bits)))) if bits else 1

    bits = min(range(HASHES + 1), key=lambda b: tables(b) * (sending + n / 2**b / 2))
    return bits, tables(bits)


def forest(hit: np.ndarray) -> np.ndarray:
    """Rows and columns of as many hits as connect what all hits connect."""
    rows, cols, out = hit.any(1), hit.any(0), []
    for first in np.flatnonzero(rows):
        if not rows[first]:
            continue
        rows[first], stack = False, [first]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(hit[i] & cols)
            cols[found] = False
            for j in found:
                more = np.flatnonzero(hit[:, j] & rows)
                rows[more] = False
                out.append((i, j))
                out += [(k, j) for k in more]
                stack += more.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def _hashed(leaders: DataFrame, theta: float, recall: float, sending: float) -> DataFrame:
    """Leaders with their bucket in each table of their label and dimension."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("n").to_pylist(), b.column("r").to_pylist()
            plan = [tables_for(k, min(theta + 2 * x, math.pi / 2), recall, sending) for k, x in zip(n, r, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("dim"), *(pa.array([p[i] for p in plan], pa.int32()) for i in (0, 1))], names=["label", "dim", "bits", "tables"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = np.stack([b.column(c).to_numpy() for c in ("dim", "bits", "tables")], 1)
            for dim, bits, tables in np.unique(kind, axis=0).tolist():
                own = b.filter(pa.array((kind == (dim, bits, tables)).all(1)))
                unit = matrix(own.column("unit"))
                keys = np.stack([hash_keys(unit, s) >> (HASHES - bits) for s in range(tables)], 1)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("rid", "label", "dim", "unit", "radius", "weight")), keys], names=["rid", "label", "dim", "unit", "radius", "weight", "keys"])

    plan = leaders.groupBy("label", "dim").agg(F.count("*").alias("n"), F.max("radius").alias("r")).mapInArrow(choose, "label long, dim int, bits int, tables int")
    return leaders.join(plan, ["label", "dim"]).mapInArrow(run, f"{LEADERS}, keys array<long>")


def _near(leaders: DataFrame, cosine: float, recall: float, sending: float) -> DataFrame:
    """What the tables find, as rows of three kinds: ``links`` (a leader's linked rows in n), ``edge`` (two leaders all of
    whose members are linked; enough of them to connect what is linked) and ``part`` (two leaders some of whose
    members may be linked)."""
    theta = float(np.arccos(cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            group = np.stack([b.column(c).to_numpy() for c in ("label", "dim", "t", "key", "i", "j")], 1)
            start = 0
            for end in [*(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), b.num_rows]:
                if start < end:
                    if at != (now := tuple(group[start].tolist())):
                        if held:
                            yield compare(pa.Table.from_batches(held).combine_chunks(), at)
                        at, held = now, []
                    held.append(b.slice(start, end - start))
                start = end
        if held:
            yield compare(pa.Table.from_batches(held).combine_chunks(), at)

    def compare(rows: pa.Table, at: tuple[int, ...]) -> pa.RecordBatch:
        t, i, j = at[2], at[4], at[5]
        unit, keys = matrix(rows.column("unit")), matrix(rows.column("keys"))[:, :t]
        rid, radius, weight, blk = (rows.column(c).to_numpy() for c in ("rid", "radius", "weight", "blk"))
        x, y = np.flatnonzero(blk == i), np.flatnonzero(blk == j)
        hit = np.zeros((len(x), len(y)), bool)
        part, least = [], math.cos(min(math.pi, theta + radius[x].max(initial=0) + radius[y].max(initial=0) + SLACK))
        for s in range(0, len(x), 256):
            own = x[s : s + 256]
            c = unit[own] @ unit[y].T
            near = c >= least
            if i == j:
                near &= own[:, None] < y[None, :]
            if not near.any():
                continue
            for k in range(t):
                near &= keys[own, k][:, None] != keys[y, k][None, :]
            p, q = np.nonzero(near)
            c, rp, rq = c[p, q], radius[own[p]], radius[y[q]]
            point = (rp == 0) & (rq == 0)
            whole = np.where(point, c >= cosine, np.arccos(np.clip(c, -1, 1)) + rp + rq <= theta - SLACK)
            hit[p[whole] + s, q[whole]] = True
            some = ~point & ~whole & (c >= np.cos(np.minimum(math.pi, theta + rp + rq + SLACK)))
            part.append(np.stack([own[p[some]], y[q[some]]], 1))
        a, b = (g[k] for g, k in zip((x, y), np.nonzero(hit), strict=True))
        n = np.bincount(a, weight[b], len(rid)) + np.bincount(b, weight[a], len(rid))
        linked, tree = np.flatnonzero(n), forest(hit)
        tree = np.stack([x[tree[:, 0]], y[tree[:, 1]]], 1)
        part = np.concatenate([np.empty((0, 2), np.int64), *part])
        zero = np.zeros(len(linked), np.int64)
        ends = [np.concatenate([f(rid[e], axis=1) for e in (tree, part)]) for f in (np.min, np.max)]
        kinds = ["links"] * len(linked) + ["edge"] * len(tree) + ["part"] * len(part)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *(pa.array(v) for v in (np.concatenate([rid[linked], ends[0]]), np.concatenate([zero, ends[1]]), np.concatenate([n[linked].astype(np.int64), np.zeros(len(ends[0]), np.int64)])))], names=["kind", "a", "b", "n"])

    hashed = cut(_hashed(leaders, theta, recall, sending))
    bucket = ["label", "dim", "t", "key"]
    member = hashed.select("rid", "label", "dim", F.posexplode("keys").alias("t", "key"))
    full = member.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1")
    n_blocks = F.ceil(F.col("m") / F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / 8 / F.col("dim")))).cast("int")
    placed = member.join(full, bucket).groupBy("rid").agg(F.collect_list(F.struct("t", "key", n_blocks.alias("blocks"))).alias("at"))
    sent = hashed.join(placed, "rid").withColumn("at", F.explode("at")).select("rid", "label", "dim", "unit", "radius", "weight", "keys", "at.*").withColumn("blk", F.pmod(F.xxhash64("rid", "t"), "blocks").cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")}).drop("blocks", "other")
    pairs = [*bucket, "i", "j"]
    return sent.repartition(*pairs).sortWithinPartitions(*pairs).mapInArrow(run, "kind string, a long, b long, n long")


def _scaled(rows: DataFrame) -> DataFrame:
    """Usable vectors at length one, others as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("vec")
            own, rest = b.filter(b.column("ok")), b.filter(pc.invert(b.column("ok")))
            if len(own):
                vec = own.column("vec")
                size = pc.list_value_length(vec).to_numpy()
                edges = np.concatenate([[0], np.cumsum(size)])
                x = vec.flatten().to_numpy(zero_copy_only=False).copy()
                # by the largest component first, so that squares neither vanish nor overflow; twice, as a component may be subnormal
                for _ in range(2):
                    x /= np.repeat(np.maximum.reduceat(np.abs(x), edges[:-1]), size)
                x /= np.repeat(np.sqrt(np.add.reduceat(x * x, edges[:-1])), size)
                yield own.set_column(at, "vec", pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x)))
            if len(rest):
                yield rest.set_column(at, "vec", pa.nulls(len(rest), pa.list_(pa.float64())))

    return rows.mapInArrow(run, rows.schema)


def near_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, gathering: int = 4, window: int = 48, recall: float = 0.999, sending: float = SENDING, block: int = 256) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    A pair at the threshold is found with probability ``recall``, a closer one with more; labels of some ten thousand
    leaders are compared whole.
    """
    small_batches(df.sparkSession)
    limit = float(np.arccos(cosine)) / 8
    rows = cut(_scaled(numbered(df, id_col, vec_col, F.col(label_col).cast("long").alias("label"))))
    good = rows.filter("ok and label is not null")
    unit = good.select("rid", "label", F.size("vec").alias("dim"), F.col("vec").alias("unit"))
    leaders = unit.withColumn("radius", F.lit(0.0)).withColumn("weight", F.lit(1).cast("long"))
    member = good.select("rid", F.col("rid").alias("lead"))
    for p in range(gathering):
        passed = cut(_gather(leaders, 100 + p, limit, window))
        leaders = passed.filter("into is null").drop("into")
        moved = passed.filter("into is not null").select(F.col("rid").alias("lead"), "into")
        member = member.join(moved, "lead", "left").select("rid", F.coalesce("into", "lead").alias("lead"))
    member = cut(member)
    near = cut(_near(leaders, cosine, recall, sending))
    sure = near.filter("kind = 'edge'").select("a", "b")
    by_lead = near.filter("kind = 'links'").select(F.col("a").alias("lead"), "n").groupBy("lead").agg(F.sum("n").alias("n"))

    # members of groups that reach each other in part are compared in blocks
    ends = lambda d: d.select(F.col("a").alias("lead")).union(d.select("b"))
    part = near.filter("kind = 'part'").select("a", "b")
    size = ends(part).distinct().join(leaders.select(F.col("rid").alias("lead"), "weight"), "lead")
    inside = member.join(size, "lead").withColumn("blk", F.pmod(F.xxhash64("rid"), F.ceil(F.col("weight") / block)))
    blocks = inside.join(unit.select("rid", "unit"), "rid").groupBy("lead", "blk").agg(F.collect_list(F.struct("rid", "unit")).alias("m"))
    both = part.join(blocks.select(F.col("lead").alias("a"), F.col("m").alias("x")), "a").join(blocks.select(F.col("lead").alias("b"), F.col("m").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_, b_, rid, n = [], [], [], []
            for i in range(b.num_rows):
                x, y = (b.column(c)[i].values for c in ("x", "y"))
                hit = matrix(x.field("unit")) @ matrix(y.field("unit")).T >= cosine
                for side, counts in ((x, hit.sum(1)), (y, hit.sum(0))):
                    own = np.flatnonzero(counts)
                    rid += side.field("rid").to_numpy()[own].tolist()
                    n += counts[own].tolist()
                    a_ += [b.column("a")[i].as_py()] * len(own)
                    b_ += [b.column("b")[i].as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a_, b_, rid, n)], names=["a", "b", "rid", "n"])

    mixed = cut(both.mapInArrow(compare, "a long, b long, rid long, n long"))
    by_row = mixed.groupBy("rid").agg(F.sum("n").alias("m"))
    comp = components(sure.union(mixed.select("a", "b").distinct()))
    linked = member.join(comp.withColumnRenamed("node", "lead"), "lead", "left").withColumn("comp", F.coalesce("component", "lead"))
    linked = linked.join(leaders.select(F.col("rid").alias("lead"), "weight"), "lead").join(by_lead, "lead", "left").join(by_row, "rid", "left").join(rows.select("rid", "id"), "rid")
    linked = linked.select("rid", "comp", (F.col("weight") - 1 + F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long").alias("n_links"), "id")
    first = linked.groupBy("comp").agg(F.min("id").alias("component_id"))
    out = rows.select("rid", "id").join(linked.join(first, "comp").select("rid", "n_links", "component_id"), "rid", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links of at least 0.93 between vectors of equal label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
