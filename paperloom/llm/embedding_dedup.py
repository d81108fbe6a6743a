"""Embedding near-dedup by iterative quantisation and multi-index Hamming tables.

Rotations that make the binary codes of the vectors balanced and close to the vectors are learned by
iterative quantisation on a bounded sample. Equal vectors of a label become one, with a weight. Every
vector is coded; each code is cut into chunks, and each chunk is the key of one table. The index has
keys and row numbers only; vectors join it for the keys that several have. Vectors that agree on label
and on the key of some table are compared by their original components in double precision. A pair is
counted in the first table that finds it, so nothing needs to be matched again, and each bucket hands on
counts and a spanning forest of its links, never its pairs. Buckets of more than BLOCK vectors are
compared block by block, as separate tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, and neither do rows with a null label or id; vectors of different lengths don't link;
repeated rows of an id are separate vectors; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .components import components

THRESHOLD = 0.98
#: Rows that the rotations are fitted on; every row is indexed.
SAMPLE = 20_000
#: Independent rotations, rounds of fitting, and bits of a chunk. 64 dimensions give 4 chunks a rotation.
ROTATIONS, ROUNDS, CHUNK = 4, 30, 16
BLOCK = 2048


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = ROUNDS, seed: int = 7) -> list[np.ndarray]:
    """Orthogonal matrices that bring unit vectors close to the corners of the cube."""
    random = np.random.default_rng(seed)
    d, out = sample.shape[1], []
    for _ in range(rotations):
        turn = np.linalg.qr(random.standard_normal((d, d)))[0]
        for _ in range(rounds if len(sample) >= d else 0):
            left, _, right = np.linalg.svd(np.where(sample @ turn >= 0, 1.0, -1.0).T @ sample)
            turn = (left @ right).T
        out.append(turn)
    return out


def keys_of(vectors: np.ndarray, turns: list[np.ndarray], chunk: int = CHUNK) -> np.ndarray:
    """One row of table keys for each unit vector."""
    out = []
    for turn in turns:
        bits = vectors @ turn >= 0
        for a in range(0, bits.shape[1] - bits.shape[1] % chunk or bits.shape[1], chunk):
            part = bits[:, a : a + chunk]
            out.append(part @ (1 << np.arange(part.shape[1])))
    return np.stack(out, axis=1).astype(np.int64)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows of usable vectors, their unit vectors), for vectors of the same, most common length in the batch; others one length at a time by the caller."""
    rows, values = [], []
    for k, v in enumerate(column):
        if v.as_py() is None or v.values.null_count or len(v.values) == 0:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        norm = np.sqrt((x * x).sum())
        if np.isfinite(x).all() and norm > 0 and np.isfinite(norm):
            rows.append(k)
            values.append(x / norm)
    return np.array(rows, np.int64), values


def _coded(batches: Iterator[pa.RecordBatch], turns: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """label, dim, id, keys of all tables, vector."""
    for batch in batches:
        rows, values = _units(batch.column("embedding"))
        for dim in sorted({len(v) for v in values}):
            own = [k for k, v in enumerate(values) if len(v) == dim]
            unit, at = np.stack([values[k] for k in own]), pa.array(rows[own])
            keys = keys_of(unit, turns[dim] if dim in turns else learn(np.zeros((0, dim))))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            columns = [batch.column("label").take(at), pa.array(np.full(len(at), dim, np.int32)), batch.column("vec_id").take(at), flat, pa.array([x.tobytes() for x in unit], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["label", "dim", "vec_id", "keys", "unit"])


def _compare(group: pa.Table, threshold: float) -> pa.Table:
    """Links within one block, or between two: per vector the number of links that this table finds first, and a neighbour that keeps components together."""
    slot, two = group.column("slot")[0].as_py(), group.column("left")[0].as_py() != group.column("right")[0].as_py()
    side, ids, weight = (group.column(c).to_numpy() for c in ("side", "vec_id", "weight"))
    row = group.column("row_id").to_numpy()
    units = np.stack([np.frombuffer(x, np.float64) for x in group.column("unit").to_pylist()])
    keys = np.stack([np.array(x) for x in group.column("keys").to_pylist()])
    a = np.flatnonzero(side == 0) if two else np.arange(len(ids))
    b = np.flatnonzero(side == 1) if two else a
    counts, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

    for i in range(0, len(a), 512):
        part = a[i : i + 512]
        near = units[part] @ units[b].T >= threshold
        if not two:
            near &= part[:, None] < b[None, :]
        x, y = np.nonzero(near)
        x, y = part[x], b[y]
        if slot:  # found by an earlier table already
            fresh = ~(keys[x][:, :slot] == keys[y][:, :slot]).any(axis=1)
            x, y = x[fresh], y[fresh]
        np.add.at(counts, x, weight[y])
        np.add.at(counts, y, weight[x])
        while (root[x] != root[y]).any():  # each end takes the smaller label, then labels of labels
            least = np.minimum(root[x], root[y])
            np.minimum.at(root, root[x], least)
            np.minimum.at(root, root[y], least)
            root = root[root]
    while (root[root] != root).any():
        root = root[root]
    has = np.flatnonzero(counts)
    return pa.table({"row_id": row[has], "vec_id": ids[has], "n_links": counts[has], "near": ids[root[has]]})


def linked(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, rotations: int = ROTATIONS) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of the input."""
    rows = cut(vectors.select("vec_id", "label", "embedding").withColumn("row_id", F.monotonically_increasing_id()))
    usable = rows.where("vec_id is not null and label is not null and embedding is not null")
    fit = usable.select(F.xxhash64("vec_id").alias("h"), "vec_id", "embedding").orderBy("h", "vec_id").limit(sample).select("embedding").toArrow()
    values = _units(fit.column("embedding").combine_chunks())[1] if len(fit) else []
    turns = {dim: learn(np.stack([v for v in values if len(v) == dim]), rotations) for dim in {len(v) for v in values}}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    tagged = usable.select("label", F.struct("vec_id", "row_id").alias("vec_id"), "embedding")
    kind = f"label {kinds['label']}, dim int, vec_id struct<vec_id: {kinds['vec_id']}, row_id: long>, keys array<long>, unit binary"
    coded = map_arrow(tagged, lambda b: _coded(b, turns), kind)
    coded = cut(coded.select("label", "dim", "vec_id.vec_id", "vec_id.row_id", "keys", "unit", F.sha2("unit", 256).alias("digest")))
    same = cut(coded.groupBy("label", "dim", "digest").agg(F.min(F.struct("vec_id", "row_id")).alias("first"), F.count("*").alias("weight")))
    firsts = same.select(F.col("first.row_id").alias("row_id"), "weight")
    index = coded.select("label", "dim", "row_id", F.posexplode("keys").alias("slot", "key")).join(firsts, "row_id")
    bucket = ["label", "dim", "slot", "key"]
    index = cut(index)
    sizes = index.groupBy(*bucket).count().where("count > 1").select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    placed = index.join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.join(coded.select("row_id", "vec_id", "keys", "unit"), "row_id").select("*", other).select(
        *bucket, "keys", "unit", "vec_id", "row_id", "weight",
        F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    found = cut(dealt.groupBy(*bucket, "left", "right").applyInArrow(lambda g: _compare(g, threshold), f"row_id long, vec_id {kinds['vec_id']}, n_links long, near {kinds['vec_id']}"))
    between = found.groupBy("row_id").agg(F.sum("n_links").alias("n_links"))
    of_class = same.join(between, same["first.row_id"] == between["row_id"], "left").select("label", "dim", "digest", "first", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    members = coded.select("label", "dim", "digest", "vec_id", "row_id").join(of_class, ["label", "dim", "digest"])
    counts = members.select("row_id", "n_links")
    ways = found.where("vec_id <> near").select(F.col("vec_id").alias("a"), F.col("near").alias("b"))
    labels = components(ways.unionByName(members.where("vec_id <> first.vec_id").select(F.col("vec_id").alias("a"), F.col("first.vec_id").alias("b"))))
    joined = rows.select("vec_id", "row_id").join(counts, "row_id", "left").join(labels, F.col("vec_id") == F.col("id"), "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9(vectors: DataFrame) -> DataFrame:
    return linked(vectors)


ORACLE_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), sized AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM unit
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM sized p JOIN sized q ON p.label = q.label AND p.vec_id < q.vec_id AND p.norm > 0 AND q.norm > 0
  WHERE list_inner_product(p.v, q.v) / (p.norm * q.norm) >= 0.98
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT ways.b, reach.root FROM reach JOIN ways ON ways.a = reach.node WHERE reach.root < ways.b
), least AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degree AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN degree ON a = vec_id
"""
