"""Mixing sources to target weights by a low-discrepancy schedule.

A source's target, in words, is cut into slots of `block` words, of which the last may be shorter.
Point t of the golden-ratio sequence, mapped through the cumulative numbers of slots, names the
source of slot t; the slots of a source are ranked, and slot k takes block k modulo the source's
blocks. Where the points give a source more slots than it has, the last are left out; where they
give fewer, by the sequence's discrepancy, the rest stand at the end. So each source takes its target to
the word, however small it is, and every prefix of the slots holds the sources at nearly their
targets' shares. The slots are the result: `mix` gives each row the slots at which it is taken, and
`mixed` puts the rows out in that order. A block holds `block` consecutive words of the source's documents in
a shuffled order that a digest of doc_id (of the text where that is null) fixes, so reruns agree.

A source may hold a third of all rows or more: prefix sums and ranks run in two levels (inside
RANGES digest ranges or slot ranges, then over those), so no task sees a whole source. Only the sources
themselves, one row each, pass through one task: their number must fit in one (some millions).

Results for odd rows: null and empty texts have size 0 and are taken 0 times; the null source is
a source, last in order; repeated rows are rows of their own; texts of any length are one row; an
empty table gives no rows; columns other than doc_id, text and source are not read, whatever their
names. Sources whose documents hold no word have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch

WEIGHTS = (5, 2, 1)
#: Words of a block and of a slot, at every size of the table.
BLOCK = 4096
CELLS = 4096
#: Ranges of a source's digests: what four hexadecimal digits tell apart.
RANGES = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", (F.size(F.split(text, SPACE)) - F.when(text.rlike(rf"^{SPACE}"), 1).otherwise(0) - F.when(text.rlike(rf"{SPACE}$") | (text == ""), 1).otherwise(0)).cast("long").alias("size"), F.md5(text).alias("mark"))


def targets(rows: DataFrame, total=1.5, most=2.0, weights=WEIGHTS) -> DataFrame:
    """One row a source: src, source, source_size, target.

    The level l with sum(min(most * size, l * weight)) = total is exact: in ascending order of
    most * size / weight the sources before some place are full and the others share the rest. Past
    that place the same quotient, which takes too many for full, only falls: the largest holds."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("src") - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("src", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy("fill", "src")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    by = by.withColumn("fill", F.col("cap") / F.col("weight"))
    by = by.withColumn("level", (F.sum("source_size").over(every) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every))
    return by.select("src", "source", "source_size", F.when(F.col("fill") <= F.col("level"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def placed(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows with src and the place [at, at + size) in their source's shuffled words."""
    rows = rows.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("mark")))).withColumn("range", F.conv(F.substring("digest", 1, 4), 16, 10).cast("long"))
    rows = rows.join(by.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inner = Window.partitionBy("src", "range").orderBy("digest", "doc_id", "size")
    rows = rows.withColumn("row", F.row_number().over(inner)).withColumn("near", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    ranges = rows.groupBy("src", "range").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("src").alias("s"), F.col("range").alias("g"), F.coalesce(F.sum("words").over(up), F.lit(0)).alias("base"))
    return rows.join(ranges, (F.col("src") == F.col("s")) & (F.col("range") == F.col("g"))).withColumn("at", F.col("base") + F.col("near")).drop("s", "g", "base", "near", "digest")


def schedule(spark, by: DataFrame, block: int, slots: int) -> DataFrame:
    """(slot, src, k, part, take): the source of each slot, its rank there, the block it takes, and
    how many of its words."""
    # frac(slot * 0.618...) in two parts, so that long schedules keep their digits.
    ratio, high = 0.6180339887498949, (0.6180339887498949 * 1048576) % 1.0
    point = F.pmod(F.pmod(F.floor(F.col("slot") / 1048576) * F.lit(high), F.lit(1.0)) + F.pmod(F.col("slot") % 1048576 * F.lit(ratio), F.lit(1.0)), F.lit(1.0))
    points = spark.range(1, slots + 1).withColumnRenamed("id", "slot").withColumn("x", point).withColumn("cell", F.floor(F.col("x") * CELLS))
    up = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    share = by.where("slots > 0").withColumn("high", F.sum("slots").over(up) / F.sum("slots").over(Window.partitionBy())).withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("src")))
    share = share.withColumn("high", F.when(F.lead("src").over(Window.orderBy("src")).isNull(), 1.0).otherwise(F.col("high")))
    cells = share.select("src", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    named = points.join(cells, "cell").where("x >= low and x < high").select("slot", "src", F.floor(F.col("slot") / 4096).alias("span"))
    inner = Window.partitionBy("src", "span").orderBy("slot")
    named = named.withColumn("rank", F.row_number().over(inner))
    spans = named.groupBy("src", "span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = spans.select(F.col("src").alias("s"), F.col("span").alias("g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = named.join(bases, (F.col("src") == F.col("s")) & (F.col("span") == F.col("g"))).select("slot", "src", (F.col("base") + F.col("rank") - 1).alias("k"))
    short = by.join(spans.groupBy("src").agg(F.sum("n").alias("got")), "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    short = short.select("src", F.explode(F.sequence("got", F.col("slots") - 1)).alias("k")).select((F.lit(slots) + F.row_number().over(Window.orderBy("k", "src"))).alias("slot"), "src", "k")
    every = ranked.union(short).join(by.select("src", "slots", "parts", "cut"), "src").where("k < slots")
    return every.select("slot", "src", "k", (F.col("k") % F.col("parts")).alias("part"), F.when(F.col("k") == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(block)).alias("take"))


def with_slots(by: DataFrame, block: int) -> DataFrame:
    """by with parts, the blocks of a source; slots, those that its target takes; and cut, the words
    of the last one."""
    by = by.withColumn("words", F.round("target").cast("long")).withColumn("parts", F.ceil(F.col("source_size") / block))
    size = F.greatest("source_size", F.lit(1))
    by = by.withColumn("rest", F.col("words") % size).withColumn("more", F.ceil(F.col("rest") / block))
    cut = F.when(F.col("rest") > 0, F.col("rest") - (F.col("more") - 1) * block).otherwise(F.lit(block)).cast("long")
    return by.select("src", "source", "source_size", "target", "parts", (F.floor(F.col("words") / size) * F.col("parts") + F.col("more")).alias("slots"), cut.alias("cut"))


def mix(docs: DataFrame, total=1.5, most=2.0, weights=WEIGHTS, block=BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, the source, mark, the text's MD5, and
    starts, for each row of docs. first_slot: the first slot that takes words of the row; starts: the
    slots, in order, that take the block of its first word, one for each time the mix comes round to it.
    Both null where none is taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.put(sized(docs), "sized")
    by = scratch.put(targets(rows, total, most, weights), "sources")
    at = scratch.put(placed(rows, by), "placed")
    by = scratch.put(with_slots(by, block), "slots")
    slots = schedule(spark, by, block, by.agg(F.sum("slots")).collect()[0][0] or 0).drop("k")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = at.where("size > 0").select("src", "range", "row", "at", "size", first.alias("first"), F.explode(F.sequence(first, last)).alias("part"))
    overlap = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), F.col("part") * block + F.col("take")) - F.greatest(F.col("at"), F.col("part") * block))
    pieces = pieces.join(slots, ["src", "part"]).withColumn("overlap", overlap).where("overlap > 0")
    starts = F.sort_array(F.collect_list(F.when(F.col("part") == F.col("first"), F.col("slot"))))
    taken = pieces.groupBy("src", "range", "row").agg(F.sum("overlap").alias("taken"), F.min("slot").alias("first_slot"), starts.alias("starts"))
    return at.join(taken, ["src", "range", "row"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot", "source", "mark", "starts")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, text, size and slot, a row for each time that the mix takes the row, to the
    nearest whole number of times, in the order of the slots. Rows of which the mix takes less than
    half, and rows without words, are left out; rows that share id, source and text are taken equally
    often."""
    rows = mix(docs, **how).groupBy("doc_id", "source", "mark").agg(F.sum("taken").alias("taken"), F.sum("size").alias("all"), F.max("size").alias("size"), F.min("first_slot").alias("first_slot"), F.min("starts").alias("starts"))
    rows = rows.where("taken > 0").withColumn("times", F.floor(F.col("taken") / F.col("all") + 0.5).cast("int")).where("times > 0")
    each = F.explode(F.sequence(F.lit(0), F.col("times") - 1))
    rows = rows.select(F.col("doc_id").alias("id"), F.col("source").alias("of"), "mark", "size", "first_slot", "starts", each.alias("time"))
    slot = F.coalesce(F.get("starts", F.col("time")), F.array_max("starts"), "first_slot")
    rows = rows.select("id", "of", "mark", "size", "time", slot.alias("slot"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("mark"))
    return docs.select("doc_id", "source", "text").join(rows, same).orderBy("slot", "mark", "doc_id", "time").select("doc_id", "source", "text", "size", "slot")


ORACLE_SQL = """
WITH rows AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size, md5(coalesce(text, '')) AS mark, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS digest FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, ([5, 2, 1])[(src - 1) % 3 + 1]::DOUBLE AS weight FROM s1),
s3 AS (SELECT *, cap / weight AS fill FROM s2),
s4 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM s3),
s5 AS (SELECT *, max(CASE WHEN l <= fill THEN l END) OVER () AS level FROM s4),
by_source AS (SELECT src, source, source_size, CASE WHEN fill <= level THEN cap ELSE level * weight END AS target FROM s5),
size_of AS (SELECT 4096::BIGINT AS block),
c0 AS (SELECT src, source_size, round(target)::BIGINT AS w, ceil(source_size / block)::BIGINT AS parts, round(target)::BIGINT % greatest(source_size, 1) AS rest, block FROM by_source, size_of),
c AS (SELECT src, parts, (w // greatest(source_size, 1)) * parts + ceil(rest / block)::BIGINT AS n, CASE WHEN rest > 0 THEN rest - (ceil(rest / block)::BIGINT - 1) * block ELSE block END AS cut, block FROM c0),
slots AS (SELECT unnest(generate_series(1, coalesce((SELECT sum(n)::BIGINT FROM c), 0))) AS slot),
points AS (SELECT slot, fmod(fmod((slot // 1048576) * fmod(0.6180339887498949::DOUBLE * 1048576, 1), 1) + fmod((slot % 1048576) * 0.6180339887498949::DOUBLE, 1), 1) AS x FROM slots),
h AS (SELECT *, sum(n) OVER (ORDER BY src) / (sum(n) OVER ())::DOUBLE AS high FROM c WHERE n > 0),
share AS (SELECT src, lag(high, 1, 0) OVER (ORDER BY src) AS low, CASE WHEN lead(src) OVER (ORDER BY src) IS NULL THEN 1 ELSE high END AS high FROM h),
named AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS k FROM points JOIN share ON x >= low AND x < high),
got AS (SELECT src, count(*) AS got FROM named GROUP BY src),
short AS (SELECT src, unnest(generate_series(coalesce(got, 0), n - 1)) AS k FROM c LEFT JOIN got USING (src) WHERE coalesce(got, 0) < n),
every AS (SELECT * FROM named UNION ALL SELECT (SELECT count(*) FROM slots) + row_number() OVER (ORDER BY k, src), src, k FROM short),
uses AS (SELECT slot, src, k % parts AS part, CASE WHEN k = n - 1 THEN cut ELSE block END AS take FROM every JOIN c USING (src) WHERE k < n),
placed AS (SELECT rows.*, src, source_size, target, row_number() OVER () AS r, sum(size) OVER (PARTITION BY src ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM rows JOIN by_source ON rows.source IS NOT DISTINCT FROM by_source.source),
pieces AS (SELECT r, src, a, size, unnest(generate_series((a // block)::BIGINT, ((a + size - 1) // block)::BIGINT)) AS part FROM placed, size_of WHERE size > 0),
took AS (SELECT r, sum(words) AS taken, min(slot) AS first_slot FROM (SELECT r, slot, greatest(0, least(a + size, part * block + take) - greatest(a, part * block)) AS words FROM pieces JOIN uses USING (src, part), size_of) WHERE words > 0 GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot, source, mark FROM placed LEFT JOIN took USING (r)
"""
