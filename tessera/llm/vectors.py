"""Near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

Normalised vectors of cosine 0.9 lie 0.447 apart. A hash floor((a.v + b) / WIDTH) with a
Gaussian ``a`` is equal for both with probability 0.90, and for unrelated vectors, 1.41 apart, with
0.69. Several hashes make a table's key; there are so many tables that such a pair
misses all of them with probability MISS at most, closer pairs far less often. The number
of hashes grows with the logarithm of the number of vectors, so that a bucket holds
STRANGERS unrelated vectors at most, about, however many there are.

Equal vectors are one class with a weight. In the buckets, classes are compared by their
components in 8 bits; the bound on what that can change decides, so no pair that shares a
bucket is lost. What hangs together so is a cluster. In each cluster, all pairs are compared
exactly, once, in tiles of bounded size. A tile returns one row a class: its links and one
neighbour that spans them, so no list of pairs is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_heavy, lookup, spread, table, written
from .graph import components, union_find

WIDTH, LEAST_HASHES = 3.58, 8
COSINE = 0.9
MISS, STRANGERS = 0.006, 1000
#: Most classes of a block, and bytes of its vectors; a bucket or cluster of up to two blocks is one tile.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Links of a tile above which they are spanned as a matrix and not one by one.
DENSE = 50_000


def chance(distance: float) -> float:
    """The probability that one hash is equal for two points so far apart."""
    r = WIDTH / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(vectors: int, cosine: float = COSINE) -> tuple[int, int]:
    """(tables, hashes of each) for so many vectors."""
    near, far = chance(math.sqrt(max(1e-9, 2 - 2 * cosine))), chance(math.sqrt(2))
    hashes = LEAST_HASHES
    while vectors * far**hashes > STRANGERS:
        hashes += 1
    return math.ceil(math.log(MISS) / math.log1p(-(near**hashes))), hashes


def projections(dim: int, tables: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(dim)
    return rng.standard_normal((dim, tables * hashes)), rng.uniform(0, WIDTH, tables * hashes)


def usable(values: list | None) -> np.ndarray | None:
    """The vector in double precision, or None if it is null, empty, zero, or holds a null or non-finite component."""
    if not values or any(x is None for x in values):
        return None
    v = np.asarray(values, np.float64) + 0.0  # no negative zero, so equal vectors have equal bytes
    return v if np.isfinite(v).all() and v.any() else None


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()  # neither overflow nor underflow in the norm
    return v / np.sqrt(v @ v)


def pack(v: np.ndarray) -> bytes:
    """The vector's bytes after one that tells their width: single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return b"s" + single.tobytes() if (single == v).all() else b"d" + v.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, {b"s": np.float32, b"d": np.float64}[b[:1]], offset=1).astype(np.float64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table_keys(vectors: np.ndarray, tables: int, hashes: int, made: dict) -> np.ndarray:
    """A 64-bit key of each unit vector (rows) in each table."""
    dim = vectors.shape[1]
    if dim not in made:
        made[dim] = projections(dim, tables, hashes)
    a, b = made[dim]
    cells = np.floor((vectors @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, hashes)
    key = np.broadcast_to(_mixed(np.arange(tables, dtype=np.uint64) + np.uint64(dim * 100_000 + 1)), cells.shape[:2]).copy()
    for i in range(hashes):
        key = _mixed(key ^ cells[:, :, i]) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def short(v: np.ndarray) -> bytes:
    """A unit vector in 8 bits a component, after its scale and how far it lies from the vector (single precision, rounded up)."""
    scale = np.float32(np.abs(v).max() / 127)
    small = np.rint(v / scale).astype(np.int8)
    return np.array([scale, np.linalg.norm(v - small * np.float64(scale)) * 1.0001 + 1e-7], np.float32).tobytes() + small.tobytes()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            raw = [usable(x) for x in part["embedding"].to_pylist()]
            digest = [None if v is None else xxhash.xxh3_128_digest(v.tobytes()) for v in raw]
            yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(digest, pa.binary()), pa.array([None if v is None else pack(v) for v in raw], pa.binary())], names=["vec_id", "digest", "vector"])


def _keys(tables: int, hashes: int, compared: bool):
    """A row for each table: key, and if ``compared`` the class and its short vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                units = [unit(unpack(b.as_py())) for b in part["vector"]]
                for dim in sorted({len(v) for v in units}):
                    own = np.array([i for i, v in enumerate(units) if len(v) == dim])
                    keys = table_keys(np.stack([units[i] for i in own]), tables, hashes, made)
                    columns = [pa.array(keys.ravel())]
                    if compared:
                        again = np.repeat(own, tables)
                        columns += [part["rep"].take(pa.array(again)), pa.array([short(v) for v in units], pa.binary()).take(pa.array(again))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "rep", "short"][: len(columns)])

    return run


def spanning(mask: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each one over a symmetric link matrix."""
    m = mask.shape[-1]
    label = np.arange(m, dtype=np.int32)
    while True:
        low = np.minimum(label, np.where(mask, label[None, :], np.int32(m)).min(-1, initial=m)).astype(np.int32)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def roots(mask: np.ndarray) -> np.ndarray:
    a, b = np.nonzero(np.triu(mask)) if np.count_nonzero(mask) <= DENSE else (None, None)
    return spanning(mask) if a is None else union_find(a, b, len(mask))


def allowed(own: np.ndarray, whole: bool) -> np.ndarray:
    """Pairs that a tile compares: all of one block, else those of different blocks."""
    mask = np.ones((len(own), len(own)), bool) if whole else own[:, None] != own[None, :]
    np.fill_diagonal(mask, False)
    return mask


def _in_tiles(ids: tuple[str, ...], judge: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """Gives ``judge`` the rows of each tile; tiles follow each other in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []  # parts of a tile that may go on
        last = None

        def done():
            whole = pa.Table.from_batches(left).combine_chunks().to_batches()[0] if len(left) > 1 else left[0]
            return judge(whole) if whole.num_rows > 1 else None

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch[c].to_numpy() for c in ids])
            cuts = [0, *(np.nonzero((at[:, 1:] != at[:, :-1]).any(0))[0] + 1).tolist(), batch.num_rows]
            found = []
            for s, e in zip(cuts, cuts[1:]):
                tile = tuple(at[:, s].tolist())
                if tile != last and left:
                    found.append(done())
                    left = []
                last = tile
                left.append(batch.slice(s, e - s))
            if found := [x for x in found if x is not None]:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
        if left and (out := done()) is not None:
            yield out

    return run


def _meet(cosine: float):
    """Links that span what may be linked in a bucket's tile."""

    def judge(tile: pa.RecordBatch) -> pa.RecordBatch | None:
        size = pc.binary_length(tile["short"]).to_numpy()
        found = []
        for n in np.unique(size):  # vectors of other lengths meet by accident only
            part = tile.filter(pa.array(size == n)) if (size != n).any() else tile
            flat = np.frombuffer(b"".join(part["short"].to_pylist()), np.uint8).reshape(part.num_rows, n)
            head = flat[:, :8].copy().view(np.float32)
            v = flat[:, 8:].view(np.int8).astype(np.float32) * head[:, :1]
            off = head[:, 1]
            mask = v @ v.T
            mask += off[:, None] + off[None, :] + off[:, None] * off[None, :]
            mask = (mask >= np.float32(cosine - 1e-5)) & allowed(part["own"].to_numpy(), part["i"][0] == part["j"][0])
            if mask.any():
                root, rep = roots(mask), part["rep"].to_numpy()
                far = np.nonzero(root != np.arange(len(root)))[0]
                found.append(pa.RecordBatch.from_arrays([pa.array(rep[far]), pa.array(rep[root[far]])], names=["a", "b"]))
        return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if found else None

    return _in_tiles(("key", "i", "j"), judge)


def _compare(cosine: float):
    """rep, links, near of the classes that have links in a cluster's tile, by exact cosines."""

    def judge(tile: pa.RecordBatch) -> pa.RecordBatch | None:
        units = [unit(unpack(b.as_py())) for b in tile["vector"]]
        if len({len(v) for v in units}) > 1:
            raise ValueError("a cluster holds vectors of several lengths")
        v = np.stack(units)
        mask = (v @ v.T >= cosine) & allowed(tile["own"].to_numpy(), tile["i"][0] == tile["j"][0])
        if not mask.any():
            return None
        rep, has = tile["rep"].to_numpy(), mask.any(1)
        links = mask @ tile["weight"].to_numpy().astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array(x[has]) for x in (rep, links.astype(np.int64), rep[roots(mask)])], names=["rep", "links", "near"])

    return _in_tiles(("component", "i", "j"), judge)


def _tiled(rows: DataFrame, key: str, *keep: str) -> DataFrame:
    """``rows`` of (key, rep, blocks, ...) once for each tile (key, i, j) of their key, tile after tile; a null ``blocks`` is one."""
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    out = rows.select("rep", key, *keep, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    out = out.select("rep", key, *keep, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return out.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, ...).

    Vectors of one length with a cosine of at least ``cosine`` are linked; n_links counts
    the other rows linked directly, component_id is the smallest vec_id that links reach,
    the row's own included. A null, empty or zero vector, or one with a null or
    non-finite component, has no links and is its own component. Vectors may be of any length.
    Rows that share a vec_id are one node, each with its own count. A row with a null vec_id
    takes its equals' component. An empty table gives no rows. Other columns are not read.
    """
    hashed = written(spread(vectors.select("vec_id", "embedding")).mapInArrow(_digest, "vec_id long, digest binary, vector binary"), "vectors")
    # classes are compared under an id of their own: rows may share a vec_id or have none
    classes = hashed.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    reps = written(classes.select(F.xxhash64("digest").alias("rep"), "vec_id", "digest", "weight", "vector"), "reps")
    seen = reps.agg(F.count("*").alias("n"), F.avg(F.octet_length("vector")).alias("bytes")).first()
    tables, hashes = shape(seen.n, cosine)
    block = min(BLOCK, max(64, int(BLOCK_BYTES / (2 * max(1.0, seen.bytes or 0.0)))))  # in double precision a vector takes up to twice its bytes
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    crowded = F.col("n") > 2 * block

    keys = reps.select("vector").mapInArrow(_keys(tables, hashes, False), "key long")
    crowds = written(keys.groupBy("key").agg(F.count("*").alias("n")).where(crowded).select("key", "n", blocks), "crowds")
    rows = reps.select("rep", "vector").mapInArrow(_keys(tables, hashes, True), "key long, rep long, short binary")
    tiles = _tiled(lookup(rows, crowds, "key", F.col("rep"), seen.n * tables), "key", "short")
    clusters = components(tiles.mapInArrow(_meet(cosine), "a long, b long"), "a", "b")

    sizes = written(clusters.groupBy("component").agg(F.count("*").alias("n")).where(crowded).select("component", "n", blocks), "sizes")
    members = clusters.select(F.col("node").alias("rep"), "component")
    members = written(lookup(members, sizes, "component", F.col("rep"), seen.n).withColumn("n", F.lit(1)), "members")
    whole = lookup(reps.select("rep", "weight", "vector"), members, "rep", F.col("rep"), seen.n).where("component is not null")
    found = written(_tiled(whole, "component", "weight", "vector").mapInArrow(_compare(cosine), "rep long, links long, near long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # from the classes' own ids to vec_ids, then components over those
    name = reps.select("rep", "vec_id")
    edges = found.select("rep", "near").distinct().join(name, "rep").select("near", F.col("vec_id").alias("a"))
    edges = edges.join(name.withColumnRenamed("rep", "near"), "near").select("a", F.col("vec_id").alias("b"))
    joined = components(edges, "a", "b")
    named = reps.select("rep", "digest", "vec_id", F.col("weight").alias("n")).join(counts, "rep", "left")
    named = named.join(joined.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    named = written(named.select("digest", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component")), "named")
    out = join_heavy(hashed.select("vec_id", "digest"), named, "digest", F.xxhash64("vec_id"), hashed.count())
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    drop(reps, crowds, clusters, sizes, members, found, joined)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs; the small tables allow it.
SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
