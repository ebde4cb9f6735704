"""Mixing sources to target weights by a time-varying curriculum, in DataFrame operations only.

Training time runs from 0 to 1. A source's share of the words drawn at time t is its
target times a schedule 1 + slope * (2t - 1), whose integral over the whole run is 1;
its demand up to t is target * D(t), D(t) = (1 - slope) * t + slope * t**2. A document
stands at some offset of its source's stream of words, and each of its copies at the time
t = D**-1(offset / target) at which the demand reaches it. Sorting by time gives the
training order; the demand of all sources together, A * t + B * t**2, gives the range partition
of a time, so nothing has to be sampled for ranges.

Everything is planned on a table without texts, which one pass over the documents
writes. What the plan says of a document follows from small tables by source: the words
of each cell of its hashes, and the last lot drawn of each class of sizes. The texts
themselves are then moved once, to their place in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, lookup, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: A source's schedule slopes, repeating as the weights do: heavy sources early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
SEED = "tessera"
#: Leading hexadecimal digits of a hash that name its cell in the stream, and of a lot in the search for the last one drawn of a class.
STREAM_CELL, CLASS_CELL = 2, 3


def position(share: Column, slope: Column) -> Column:
    """The time at which a source has had ``share`` (0 to 1) of its target: the root of D(t) = share."""
    flat = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(flat * flat + 4 * slope * share) - flat) / (2 * slope))


def marked(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, source, size, the hash ``_at`` that orders the source's stream, ``_s`` (source, never null), ``_class`` (of sizes that differ by an eighth at most)."""
    at = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), at.alias("_at"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"), *keep)
    return rows.withColumn("_class", size_class("size"))


def size_class(size: str) -> Column:
    return F.expr(f"CASE WHEN {size} < 16 THEN {size} ELSE 16 * (length(bin({size})) - 4) + shiftright({size}, length(bin({size})) - 4) END").cast("int")


def lot(at: str = "_at") -> Column:
    """The hash backwards: which documents are drawn once more does not depend on where they stand in the stream."""
    return F.reverse(at)


def cell(digits: int, of: Column) -> Column:
    return F.substring(of, 1, digits)


def ranked(sources: DataFrame) -> DataFrame:
    """``sources``, one row each, with ``rank`` from 0 by code point, null last: range partitions are counted, then each numbers its own."""
    by = F.col("source").asc_nulls_last()
    parts = written(sources.repartitionByRange(by).withColumn("_part", F.spark_partition_id()), "ranked")
    # one row a partition meets here
    first = parts.groupBy("_part").count().select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return parts.withColumn("rank", own).join(F.broadcast(first), "_part").withColumn("rank", F.col("rank") + F.col("_first")).drop("_part", "_first")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size, ...) with target, slope, ``whole`` and ``rest``.

    Sources share all words by weight; those that reach MOST_COPIES sizes stop there and
    the level of the others rises, until none is above. Each round is one sum over the
    sources. whole: how often the target holds the whole source; rest: the words of the target beyond that.
    """
    ranks = ranked(sizes)
    weight, slope = (F.element_at(F.array(*map(F.lit, x)), (F.pmod("rank", F.lit(len(x))) + 1).cast("int")) for x in (WEIGHTS, SLOPES))
    known = written(ranks.withColumn("_weight", weight).withColumn("slope", slope).withColumn("_cap", MOST_COPIES * F.col("source_size").cast("double")).drop("rank"), "weights")
    level = -1.0
    while True:
        full = F.col("_cap") <= level * F.col("_weight")
        r = known.agg(F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("free"), F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("taken"), F.sum("source_size").alias("all")).first()
        reached = (r["all"] - r.taken) / r.free if r.free else level
        if reached <= level:
            break
        level = reached
    out = known.withColumn("target", F.least("_cap", F.lit(level) * F.col("_weight")))
    whole = F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long")
    return out.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("_weight", "_cap")


def last_drawn(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(_s, _class, n, last): the documents of that class whose lot() is up to ``last`` are drawn once more for the rest of the target.

    Classes of sizes are taken from the largest to the smallest; each draws as many documents as
    come nearest to its share of the rest and what larger classes left over or drew too
    much. So what is missed in the end is about half of one of the smallest documents.
    """
    key = ["_s", "_class"]
    counted = written(rows.where("size > 0").groupBy(*key, cell(CLASS_CELL, lot()).alias("_cell")).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "classes")
    classes = counted.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    # a source has some 500 classes at most
    listed = classes.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_class", "n", "words")), False).alias("list")).join(goals.select("_s", "source_size", "rest"), "_s")
    share = F.col("rest") / F.col("source_size")

    def draw(s: Column, x: Column) -> Column:
        want = share * x["words"] + s["left"]
        mean = x["words"] / x["n"]
        n = F.greatest(F.lit(0.0), F.least(x["n"].cast("double"), F.floor(want / mean + 0.5).cast("double")))
        return F.struct((want - n * mean).alias("left"), F.array_append(s["drawn"], n.cast("long")).alias("drawn"))

    folded = listed.select("_s", "list", F.aggregate("list", F.struct(F.lit(0.0).alias("left"), F.array().cast("array<long>").alias("drawn")), draw)["drawn"].alias("drawn"))
    picks = folded.select("_s", F.explode(F.arrays_zip("list", "drawn")).alias("x")).select("_s", "x.list._class", F.col("x.list.n").alias("_all"), F.col("x.drawn").alias("_drawn"))
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("_cell")) - F.col("n")
    cut = counted.join(picks.where("_drawn > 0"), key).withColumn("_before", before).where("_before < _drawn and _drawn <= _before + n")
    cut = written(cut.select(*key, "_cell", "_all", (F.col("_drawn") - F.col("_before")).alias("_need")), "cuts")
    near = rows.withColumn("_cell", cell(CLASS_CELL, lot())).join(cut, [*key, "_cell"]).groupBy(*key, "_cell", "_all", "_need", lot().alias("_lot")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(*key, "_cell").orderBy("_lot")) - F.col("n")
    return near.withColumn("_ahead", ahead).where("_ahead < _need").groupBy(*key).agg(F.max("_all").alias("n"), F.max("_lot").alias("last"))


class Plan:
    """The tables of a mix, made from marked() rows without texts.

    stream: by source and cell of hashes, the source's words before the cell and in it, and
    what targets() says of the source. last: see last_drawn(). total: rows. linear, square:
    the demand of all sources up to time t is linear * t + square * t**2.
    """

    def __init__(self, rows: DataFrame):
        self.total = rows.count()
        cells = written(rows.groupBy("_s", cell(STREAM_CELL, F.col("_at")).alias("_cell")).agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n")), "cells")
        self.goals = written(targets(cells.groupBy("_s").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))), "targets")
        before = F.sum("words").over(Window.partitionBy("_s").orderBy("_cell")) - F.col("words")
        stream = cells.withColumn("before", before).drop("source").join(self.goals.drop("source", "rest"), "_s")
        self.stream = written(stream.withColumn("_key", F.concat("_cell", "_s")).drop("_s", "_cell"), "stream")
        last = last_drawn(rows, self.goals)
        self.last = written(last.select(F.concat(F.col("_class").cast("string"), "_s").alias("_key"), "n", "last"), "last")
        r = self.goals.agg(F.sum(F.col("target") * (1 - F.col("slope"))).alias("linear"), F.sum(F.col("target") * F.col("slope")).alias("square")).first()
        self.linear, self.square = r.linear or 0.0, r.square or 0.0

    def copies(self, rows: DataFrame) -> DataFrame:
        """marked() ``rows`` once for each copy that the mix draws, with its number ``_copy`` and its time ``_t``."""
        known = lookup(rows.where("size > 0").withColumn("_key", F.concat(cell(STREAM_CELL, F.col("_at")), "_s")), self.stream, "_key", F.col("_at"), self.total)
        known = lookup(known.withColumn("_key", F.concat(F.col("_class").cast("string"), "_s")), self.last, "_key", F.col("_at"), self.total).drop("_key")
        drawn = F.col("whole") + F.when(lot() <= F.col("last"), 1).otherwise(0)
        known = known.withColumn("_n", drawn.cast("int")).where("_n > 0")
        known = known.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        # the offset goes on within a cell as the hashes do; copies of the rest are spread over the time that whole rounds leave
        within = F.conv(F.substring("_at", STREAM_CELL + 1, 8), 16, 10).cast("double") / float(1 << 32)
        offset = F.col("before").cast("double") + within * F.col("words").cast("double")
        size = F.col("source_size").cast("double")
        pace = F.when(F.col("_copy") < F.col("whole"), F.lit(1.0)).otherwise(F.col("target") / size - F.col("whole"))
        share = F.least(F.lit(1.0), (F.col("_copy") * size + pace * offset) / F.col("target"))
        return known.withColumn("_t", position(share, F.col("slope"))).drop("_n", "last", "before", "words", "whole")

    def ordered(self, copies: DataFrame) -> DataFrame:
        """``copies`` in training order: by range of words drawn, then sorted by time, hash and copy."""
        parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        drawn = (self.linear + self.square * F.col("_t")) * F.col("_t") / (self.linear + self.square or 1.0)
        part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(drawn * parts).cast("int")))
        return copies.repartitionById(parts, part).sortWithinPartitions("_t", "_at", "_copy")


def planned(docs: DataFrame) -> tuple[DataFrame, Plan]:
    """The marked() rows of ``docs``, written without texts, and the plan made of them."""
    rows = written(marked(docs), "marked")
    return rows, Plan(rows)


def mix(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of ``docs``, each in ``_row``, once for each copy, in training order, with ``_at``, ``size``, ``_copy`` and ``_t``."""
    rows = marked(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return plan.ordered(plan.copies(rows).select("_at", "size", "_copy", "_t", "_row"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs`` (doc_id, text, source, ...) once for each copy, in training order.

    Partition follows partition, and within one rows are in order. All columns are returned,
    whatever their names. A null source is a source of its own, the last; a text
    that is null or has no word is never drawn. Rows equal in doc_id and text have one place
    in the order and are drawn equally often. Texts of any length are one row. An empty
    table gives none. Reruns agree, whatever the partitions of ``docs``.
    """
    _, plan = planned(docs)
    return mix(docs, plan).select("_row.*")


def drawn_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_position of every row of ``docs``, counted in the mix itself.

    The mix is made with its texts, sorted and written. A row that it does not hold has
    taken 0 and no position. Nulls, ties and repeated rows are as in mixed().
    """
    rows, plan = planned(docs)
    made = written(mix(docs, plan), "mix")
    drawn = made.groupBy("_at").agg((F.max("_copy") + 1).alias("copies"), F.min("_t").alias("first_position"))
    # rows without words meet nothing; they are dealt out under keys that no hash equals
    key = F.when(F.col("size") > 0, F.col("_at")).otherwise(F.concat(F.lit("-"), F.col("_at")))
    known = lookup(rows.withColumn("_key", F.col("_s")), plan.goals.select(F.col("_s").alias("_key"), "source_size", "target", F.col("source_size").alias("n")), "_key", F.col("_at"), plan.total)
    out = known.withColumn("_at", key).join(drawn, "_at", "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("copies", F.lit(0))).cast("long").alias("taken"), "first_position")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_rows(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('tessera:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS pos FROM documents),
c AS (SELECT *, CASE WHEN size < 16 THEN size ELSE 16 * (length(bin(size)) - 4) + (size >> (length(bin(size)) - 4)) END AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(rank % 3) + 1]::DOUBLE AS weight, [-0.5, 0.0, 0.5][(rank % 3) + 1]::DOUBLE AS slope, 3 * source_size::DOUBLE AS cap FROM k),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, slope, least(cap, coalesce(max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight, cap)) AS target FROM l),
g AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole, target - coalesce(floor(target / nullif(source_size, 0)), 0) * source_size AS rest FROM t),
n AS (SELECT source, class, count(*) AS n, sum(size)::BIGINT AS words FROM c WHERE size > 0 GROUP BY source, class),
a AS (SELECT source, list({'class': class, 'n': n, 'words': words} ORDER BY class DESC) AS list FROM n GROUP BY source),
f AS (
  SELECT a.source, list, list_reduce(list_prepend({'x': {'class': 0::BIGINT, 'n': 0::BIGINT, 'words': 0::BIGINT}, 'left': 0::DOUBLE, 'drawn': []::BIGINT[]},
      list_transform(list, lambda x: {'x': x, 'left': 0::DOUBLE, 'drawn': []::BIGINT[]})),
    lambda s, e: {'x': e.x,
      'left': (rest / source_size * e.x.words + s.left) - greatest(0, least(e.x.n::DOUBLE, floor((rest / source_size * e.x.words + s.left) / (e.x.words / e.x.n) + 0.5))) * (e.x.words / e.x.n),
      'drawn': list_append(s.drawn, greatest(0, least(e.x.n::DOUBLE, floor((rest / source_size * e.x.words + s.left) / (e.x.words / e.x.n) + 0.5)))::BIGINT)}).drawn AS drawn
  FROM a JOIN g ON a.source IS NOT DISTINCT FROM g.source),
p AS (SELECT source, unnest(list).class AS class, unnest(drawn) AS drawn FROM f),
b AS (SELECT source, substr(pos, 1, 2) AS cell, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
o AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY cell) - words)::BIGINT AS before FROM b),
r AS (SELECT *, rank() OVER (PARTITION BY source, class ORDER BY reverse(pos)) AS nr FROM c WHERE size > 0),
h AS (
  SELECT c.doc_id, c.size, source_size, target, whole, slope, whole + CASE WHEN r.nr <= drawn THEN 1 ELSE 0 END AS copies,
    o.before::DOUBLE + (('0x' || substr(c.pos, 3, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE) * o.words::DOUBLE AS ahead
  FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source JOIN o ON c.source IS NOT DISTINCT FROM o.source AND substr(c.pos, 1, 2) = o.cell
    LEFT JOIN (SELECT DISTINCT source, class, pos, nr FROM r) r ON c.source IS NOT DISTINCT FROM r.source AND c.class = r.class AND c.pos = r.pos
    LEFT JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.class = p.class),
q AS (SELECT *, least(1.0::DOUBLE, (CASE WHEN whole > 0 THEN 1::DOUBLE ELSE target / source_size - whole END * ahead) / target) AS share FROM h)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE size * copies END::BIGINT AS taken,
  CASE WHEN size = 0 OR copies = 0 THEN NULL WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END AS first_position
FROM q
"""
