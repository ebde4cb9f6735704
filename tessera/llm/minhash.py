"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation of the shingle hashes gives two signature values, its minimum and
its maximum, so PERMUTATIONS evaluations give twice as many values. BANDS bands of
ROWS values each make candidate buckets; a pair at similarity 0.8 misses all of them
with probability (1 - 0.8**5)**40, about 1e-7.

Steps: documents with equal shingle sets fall into one class (a digest, pre-aggregated
in the map side); the classes are bucketed; each bucket holds its members' signatures
against that of a leader drawn anew in every band. Where the leader rejects a member,
the signatures of all members that are not close to the leader are held against each
other in tiles of bounded size (a member left out, CLOSE to the leader, and one that the
leader rejects agree in under 0.65 of the values, by the triangle inequality; a pair at
0.8 does so with probability about 3e-7). What hangs together by links then is a cluster; in
each cluster all pairs are held against each other on their full sets, in tiles too, each
tile returning a spanning forest of its links. In clusters of more than one tile all are held
against the smallest document first, and only those that are not near it against all
others. No step emits all pairs of a group, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, forget, join_heavy, lookup, spread, table, tidy, written
from .graph import components, union_find

PERMUTATIONS, BANDS, ROWS = 100, 40, 5
#: Least agreement of one-byte signature values for a cluster link; 10 deviations below 0.8.
COARSE = 0.5
#: A member that agrees so far with its bucket's leader is no link of one that the leader rejects.
CLOSE = 0.85
#: Signatures of a block of a crowded bucket; up to two blocks are one tile.
CROWD = 1024
#: A cluster of up to 2 * TILE classes is one tile; larger ones are cut into blocks of TILE to MOST_TILE.
TILE, MOST_TILE, BLOCKS = 128, 2048, 24
#: Shingles of a block of full sets, about (8 bytes each): blocks are made smaller where documents are long.
TILE_SHINGLES = 2_000_000
#: Hashes of words kept by a task before it starts anew (some 150 bytes each).
WORDS_KEPT = 300_000

U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def multipliers(n: int = PERMUTATIONS) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, n, dtype=U64) * U64(2) + U64(1)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def shingle_set(text: bytes | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words, A-Z lower-cased.

    A text of fewer words is one shingle; one without words, or null, has none.
    """
    parts = text.lower().split() if text else []
    if not parts:
        return np.zeros(0, U64)
    h = np.fromiter(map(words.__getitem__, parts), U64, len(parts))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, k, U64)
    for i in range(k):
        out = _mixed(out ^ h[i : len(h) - k + 1 + i]) + _M1
    return np.unique(out)


def signature(x: np.ndarray, a: np.ndarray, step: int = 8192) -> np.ndarray:
    """Minimum and maximum under each multiplier, interleaved."""
    low = high = None
    for i in range(0, len(x), step):
        y = a[:, None] * x[None, i : i + step]
        m, n = y.min(1), y.max(1)
        low, high = (m, n) if low is None else (np.minimum(low, m), np.maximum(high, n))
    return np.stack([low, high], 1).ravel()


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        words, a = WordHashes(), multipliers()
        salt = _mixed(np.arange(1, BANDS + 1, dtype=U64) * _M1)
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            n, digest, sig, keys = [], [], [], []
            for t in texts:
                x = shingle_set(t.as_py(), width, words)
                n.append(len(x))
                if not len(x):
                    digest.append(None), sig.append(None), keys.append(None)
                    continue
                digest.append(xxhash.xxh3_128_digest(x.tobytes()))
                s = signature(x, a)
                k = salt.copy()
                for row in s[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                    k = _mixed(k ^ row) + _M1
                keys.append(k.view(np.int64))
                sig.append(((s * _M1) >> U64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "sig", "keys"],
            )
        words.clear()
        tidy()

    return run


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array((x == y).mean(1))], names=["a", "b", "agree"])


def coarse(sig: np.ndarray, own: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that span what hangs together by signatures; pairs of one block count only if the tile is one block."""
    ia, ib = [], []
    for i in range(len(sig) - 1):
        ok = (sig[i + 1 :] == sig[i]).sum(1) >= COARSE * sig.shape[1]
        if not whole:
            ok &= own[i + 1 :] != own[i]
        at = np.nonzero(ok)[0] + i + 1
        ia.append(np.full(len(at), i)), ib.append(at)
    root = union_find(np.concatenate(ia), np.concatenate(ib), len(sig))
    far = np.nonzero(root != np.arange(len(sig)))[0]
    return far, root[far]


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the tiles (key, i, j), which follow each other in a partition."""

    def take(part: pa.RecordBatch) -> pa.RecordBatch:
        rep, m = part["rep"].to_numpy(), part.num_rows
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if m > 1:
            sig = np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint8).reshape(m, -1)
            a, b = coarse(sig, part["own"].to_numpy(), part["i"][0].as_py() == part["j"][0].as_py())
        return pa.RecordBatch.from_arrays([pa.array(rep[a], pa.int64()), pa.array(rep[b], pa.int64())], names=["a", "b"])

    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        ids = np.stack([batch[c].to_numpy() for c in ("key", "i", "j")])
        cuts = (np.nonzero((ids[:, 1:] != ids[:, :-1]).any(0))[0] + 1).tolist()
        done = [take(batch.slice(s, e - s)) for s, e in zip([0, *cuts], cuts)]
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        left = batch.slice(cuts[-1] if cuts else 0)
    if left is not None:
        yield take(left)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            sets = [shingle_set(t.as_py(), width, words).tobytes() for t in texts]
            out = pa.RecordBatch.from_arrays([batch["doc_id"], batch["component"], batch["blocks"], pa.array(sets, pa.binary())], names=["rep", "component", "blocks", "shingles"])
            yield out.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))  # a further text of a document may be empty

    return run


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets with 100 * |intersection| >= percent * |union|, found exactly."""
    m, size = len(sets), np.array([len(s) for s in sets])
    if m <= 6:
        ia, ib = [], []
        for i in range(m):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        ia.append(i), ib.append(j)
        return np.array(ia, np.int64), np.array(ib, np.int64)
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), size)
    keep = df[col] > 1
    row, col = row[keep], col[keep]
    used, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((m, m), np.float32)
    total = np.zeros((m, m), np.float32 if size.max() < 1 << 24 else np.float64)  # either way counts stay exact
    for lo in range(0, len(used), 4096):
        s, e = np.searchsorted(col, [lo, lo + 4096])
        dense = np.zeros((m, min(4096, len(used) - lo)), np.float32)
        dense[row[s:e], col[s:e] - lo] = 1
        np.matmul(dense, dense.T, out=both)
        total += both
    ia, ib = [], []
    for lo in range(0, m, 256):
        shared = total[lo : lo + 256].astype(np.int64)
        i, j = np.nonzero(100 * shared >= percent * (size[lo : lo + 256, None] + size[None, :] - shared))
        keep = j < i + lo
        ia.append(i[keep] + lo), ib.append(j[keep])
    return np.concatenate(ia), np.concatenate(ib)


def _verify(percent: int):
    def run(pdf):
        import pandas as pd

        rep = pdf["rep"].to_numpy()
        ia, ib = linked([np.frombuffer(s, U64) for s in pdf["shingles"]], percent)
        root = union_find(ia, ib, len(rep))
        far = np.nonzero(root != np.arange(len(rep)))[0]
        return pd.DataFrame({"a": rep[far], "b": rep[root[far]]})

    return run


def _star(percent: int):
    """Of each document of a block: whether a text of it is near the cluster's smallest document, and whether one isn't."""

    def run(pdf):
        import pandas as pd

        rep = pdf["rep"].to_numpy()
        head = rep == pdf["component"].iloc[0]
        whole = [np.frombuffer(s, U64) for s in pdf["shingles"]]
        centres = [whole[i] for i in np.nonzero(head)[0]]

        def near(x: np.ndarray) -> bool:
            for c in centres:
                if 100 * min(len(x), len(c)) >= percent * max(len(x), len(c)):
                    both = len(np.intersect1d(x, c, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(c) - both):
                        return True
            return False

        at = np.nonzero(~head)[0]
        if not len(at):
            return pd.DataFrame({"rep": [], "component": [], "linked": [], "rest": []}).astype({"rep": "int64", "component": "int64", "linked": bool, "rest": bool})
        out = pd.DataFrame({"rep": rep[at], "near": [near(whole[i]) for i in at]}).groupby("rep")["near"].agg(["any", "all"]).reset_index()
        return pd.DataFrame({"rep": out["rep"].astype("int64"), "component": pdf["component"].iloc[0], "linked": out["any"].astype(bool), "rest": ~out["all"].astype(bool)})

    return run


def _large(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span those of large clusters, from (rep, component, blocks, shingles).

    All members are held against the cluster's smallest document first. Those near to it hang
    together already; only the rest are held against all members, so a group of near
    copies is not compared, nor its sets moved, with the square of its size.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = members.select("rep", "component", "shingles", F.explode(F.when(F.col("rep") == F.col("component"), everywhere).otherwise(F.array(own))).alias("i"))
    starred = written(dealt.groupBy("component", "i").applyInPandas(_star(percent), "rep long, component long, linked boolean, rest boolean"), "starred")
    rest = written(starred.where("rest").select("rep", "component", F.lit(1).alias("n"), F.lit(True).alias("rest")), "rest")
    sizes = starred.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("rest").cast("int")).alias("far")).where("far > 0")
    grid = written(sizes.select("component", "n", F.ceil(F.col("far") / MOST_TILE).cast("int").alias("parts")), "grid")
    total = starred.count()
    known = lookup(members, rest.drop("component"), "rep", F.col("rep"), total)
    known = join_heavy(known, grid, "component", F.col("rep"), total).where("parts is not null")
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")
    tile = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    to_all = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: tile(i, own))
    from_rest = F.when(F.col("rest"), F.transform(everywhere, lambda j: tile(part, j))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    tiles = known.select("component", "rep", "shingles", F.explode(F.concat(to_all, from_rest)).alias("tile")).select("component", "tile.i", "tile.j", "rep", "shingles")
    found = tiles.groupBy("component", "i", "j").applyInPandas(_verify(percent), "a long, b long")
    return starred.where("linked").select(F.col("rep").alias("a"), F.col("component").alias("b")).union(found)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    sets of distinct ``width``-word shingles. component_id is the smallest doc_id
    that links reach, the document's own included; kept is doc_id = component_id.
    Null, empty and blank texts have no shingles and link with nothing; texts of any length
    count whole; an empty table gives no rows. Rows that share a doc_id are one document with
    several texts. A row with a null doc_id
    takes the component of its equals, or null; it is kept in the second case.
    Other columns of ``docs`` are not read.
    """
    docs = docs.select("doc_id", "text")
    signed = written(spread(docs).mapInArrow(_sign(width), "doc_id long, n_shingles long, digest binary, sig binary, keys array<long>"), "signed")
    total = signed.count()
    classes = written(
        signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes"
    )
    # one signature row for each class: its smallest document's
    reps = signed.where("digest is not null").select("doc_id", "digest", "sig", "keys").join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
    reps = written(reps.dropDuplicates(["digest", "doc_id"]).select(F.col("doc_id").alias("rep"), "sig", "keys"), "reps")
    rows = written(reps.select("rep", F.explode("keys").alias("key")), "bands")
    banded = rows.count()
    lead = written(rows.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", "key")).alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader", "n", F.col("n").alias("size")), "leaders")
    led = written(join_heavy(rows, lead, "key", F.col("rep"), banded).where("rep != leader"), "led")  # null leaders go too
    sig = reps.select("rep", "sig").dropDuplicates(["rep"])
    pairs = written(led.select("rep", "leader").distinct(), "pairs")
    heads = written(pairs.groupBy("leader").agg(F.count("*").alias("n")).join(sig.select(F.col("rep").alias("leader"), F.col("sig").alias("sig_b")), "leader"), "heads")
    both = join_heavy(pairs.join(sig.withColumnRenamed("sig", "sig_a"), "rep"), heads, "leader", F.col("rep"), pairs.count())
    met = written(both.select(F.col("rep").alias("a"), F.col("leader").alias("b"), "sig_a", "sig_b").mapInArrow(_agree, "a long, b long, agree double"), "met")
    # a bucket whose leader rejects nobody hangs together already
    unlike = met.where(F.col("agree") < CLOSE).select(F.col("a").alias("rep"), F.col("b").alias("leader"), "agree")
    apart = written(led.where("size > 2").join(unlike, ["rep", "leader"]).select("key", "rep", "agree"), "apart")
    crowds = apart.groupBy("key").agg(F.count("*").alias("n"), F.min("agree").alias("least")).where((F.col("n") > 1) & (F.col("least") < COARSE))
    blocks = F.when(F.col("n") <= 2 * CROWD, 1).otherwise(F.ceil(F.col("n") / CROWD)).cast("int")
    crowds = written(crowds.select("key", "n", blocks.alias("blocks")), "crowds")
    placed = join_heavy(apart.select("key", "rep"), crowds, "key", F.col("rep"), apart.count()).where("blocks is not null")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    tiles = placed.select("rep", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("rep", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(sig, "rep")
    tiles = tiles.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    clusters = components(met.where(F.col("agree") >= COARSE).select("a", "b").union(tiles.mapInArrow(_crowded, "a long, b long")), "a", "b")

    # full sets are made of the clusters' members only; blocks of a cluster are bounded in sets and in bytes
    weights = signed.groupBy(F.col("doc_id").alias("node")).agg(F.sum("n_shingles").alias("words"))
    weighed = clusters.join(weights, "node")
    sizes = written(weighed.groupBy("component").agg(F.count("*").alias("n"), F.sum("words").alias("words")), "sizes")
    most = F.greatest(F.lit(TILE), F.least(F.lit(MOST_TILE), F.ceil(F.col("n") / BLOCKS)))
    parts = F.greatest(F.ceil(F.col("n") / most), F.ceil(F.col("words") / TILE_SHINGLES))
    few = (F.col("n") <= 2 * TILE) & (F.col("words") <= 2 * TILE_SHINGLES)
    plan = written(sizes.select("component", "n", F.when(few, 1).otherwise(F.least(F.col("n"), parts)).cast("int").alias("blocks")), "plan")
    placed = join_heavy(clusters, plan, "component", F.col("node"), clusters.count())
    placed = written(placed.select(F.col("node").alias("doc_id"), "component", "blocks", F.lit(1).alias("n")), "placed")

    def sets(which: str) -> DataFrame:
        full = lookup(docs, placed.where(which), "doc_id", F.xxhash64("text"), total).where("component is not null")
        return full.mapInArrow(_sets(width), "rep long, component long, blocks int, shingles binary")

    links = sets("blocks = 1").select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep", "shingles").groupBy("component", "i", "j").applyInPandas(_verify(percent), "a long, b long")
    if not plan.where("blocks > 1").isEmpty():
        links = links.union(_large(written(sets("blocks > 1"), "large"), percent))
    found = components(links, "a", "b")
    named = written(
        classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", "n", F.coalesce("component", "rep").alias("component")),
        "named",
    )
    out = join_heavy(signed.select("doc_id", "n_shingles", "digest"), named, "digest", F.xxhash64("doc_id"), total)
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    drop(classes, reps, rows, lead, led, pairs, heads, met, apart, crowds, sizes, plan, placed, clusters, found)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that near_duplicates() keeps.

    Of rows that share a doc_id and are kept, one stays for each distinct text; rows of a
    null doc_id count as one id here.
    """
    no_id = F.lit(-(2**63)).cast("long")
    kept = near_duplicates(docs, width, percent).where("kept").select(F.coalesce("doc_id", no_id).alias("_id")).distinct()
    rows = docs.select(F.coalesce("doc_id", no_id).alias("_id"), F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    # one exchange by _id serves the join and the distinct rows
    return rows.join(kept, "_id", "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


#: Exact Jaccard links and their components; the small tables allow all pairs that share a shingle.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END)) AS sh
  FROM w WHERE ws IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.seen = e2.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
