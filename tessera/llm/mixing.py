"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A document of a source with target t words and s words of its own is expected t/s times. Within a source the
documents stand in one order, the expected copies are summed along it, one random offset in [0, 1) is added,
and a document is emitted once for each integer its stretch of that sum crosses: floor(t/s) or one more copies.
Documents stand by size, so that the words taken stay close to the target and not just the copies.

In a source of few documents one large document can be most of the target, and a blind offset would miss it by
that much; so OFFSETS evenly spaced offsets are tried (sums over all documents) and the nearest is taken.

The sums need no task that sees a whole source: documents fall into buckets (source, root of the size, two
hex digits of a hash); the buckets are counted, the counts (at most 256 x the largest root a source, however
many documents it has) are summed along each source, and only then are documents ranked inside their bucket.
A third of all rows in one source, or in copies of one document, thus spreads over its hash buckets.

Cases: null or empty text has size 0 and is taken 0 words (its copies count for the order only); null source is
a source of its own, last in order; rows that repeat a doc_id, or have none, are documents of their own, and ties in the order among them
decide only which of them goes; if all sizes are 0
every target is 0; an empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common

WEIGHTS = (5, 2, 1)
MOST = 3
#: The random offset of a source is the one of so many, evenly spaced from a random start, whose words come nearest the target.
OFFSETS = 32


def with_sizes(docs: DataFrame, kept: list[str] | None = None) -> DataFrame:
    """Size in words, the bucket and the tie-breaking hash of each document, beside the columns named in kept."""
    out = docs.select(*(kept or ["doc_id", "source"]), F.expr(rf"coalesce(regexp_count(text, '{common.WORD_CLASS}'), 0)".replace("\\", "\\\\")).cast("long").alias("size"))
    out = out.withColumn("draw", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":mix"))))
    return out.withColumn("root", F.floor(F.sqrt("size")).cast("int")).withColumn("part", F.substring("draw", 1, 2))


def targets(buckets: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, target: shares of all sizes by weight, none above `most` times its source's size.

    Raising a level x from 0, source i receives min(weight_i * x, most * size_i). In order of size_i / weight_i the
    sources reach their ceilings one after another, so sums along that order give the level at which all is shared out.
    Windows without a key see one row a source here.
    """
    sources = buckets.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ceilings = sources.withColumn("weight", w).withColumn("ceiling", F.col("source_size") * most)
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = ceilings.withColumn("left_words", F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
    left = left.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The first source, in this order, that the level of all that is left does not fill sets the level for the rest.
    level = left.withColumn("level", F.when(F.col("left_words") / F.col("left_weight") <= F.col("ceiling") / F.col("weight"), F.col("left_words") / F.col("left_weight")))
    level = level.withColumn("level", F.min_by("level", F.when(F.col("level").isNotNull(), F.col("ceiling") / F.col("weight"))).over(everything))
    return level.select("source", F.col("source_size").cast("long").alias("source_size"), F.least("ceiling", F.coalesce(F.col("weight") * F.col("level"), F.col("ceiling"))).alias("target"))


def copies(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, ties: tuple[str, ...] = ()) -> DataFrame:
    """sized (see with_sizes) with source_size, target and copies, the number of times the mix emits the row.

    ties: further columns that set rows apart whose doc_id and size are the same.
    """
    buckets = sized.groupBy("source", "root", "part", "size").agg(F.count("*").alias("n"))
    goals = targets(buckets.groupBy("source", "size").agg(F.sum("n").alias("n")), weights, most)
    along = Window.partitionBy("source").orderBy("root", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.groupBy("source", "root", "part").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(along), F.lit(0)))
    starts = starts.withColumnsRenamed({"source": "s_source", "root": "s_root", "part": "s_part"}).drop("n")
    goals = goals.withColumnRenamed("source", "g_source")
    starts = starts.join(goals, F.col("s_source").eqNullSafe(F.col("g_source"))).drop("g_source")
    inside = Window.partitionBy("source", "root", "part").orderBy("size", "draw", "doc_id", *ties)
    ranked = sized.withColumn("rank", F.row_number().over(inside))
    on = F.col("source").eqNullSafe(F.col("s_source")) & (F.col("root") == F.col("s_root")) & (F.col("part") == F.col("s_part"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def times(offset: Column) -> Column:
        place = F.col("start") + F.col("rank")
        return F.least(F.floor(each * place + offset) - F.floor(each * (place - 1) + offset), F.lit(int(most)))

    placed = ranked.join(starts, on)
    sums = placed.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(times(offset(i)) * F.col("size")).alias(f"t{i}") for i in range(OFFSETS)])
    misses = [F.struct(F.abs(F.col(f"t{i}").cast("double") - F.col("target")).alias("miss"), F.lit(i).alias("i")) for i in range(OFFSETS)]
    chosen = sums.select(F.col("source").alias("c_source"), F.array_min(F.array(*misses))["i"].alias("turn"))
    starts = starts.join(chosen, F.col("s_source").eqNullSafe(F.col("c_source"))).drop("c_source")
    out = ranked.join(starts, on).drop("s_source", "s_root", "s_part")
    return out.withColumn("copies", times(offset(F.col("turn"))).cast("int")).drop("start", "rank", "turn")


def offset(turn: Column | int) -> Column:
    """A random number in [0, 1) of the source, turned on by turn / OFFSETS."""
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(":offset"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    moved = draw + (F.lit(turn) if isinstance(turn, int) else turn).cast("double") / F.lit(float(OFFSETS))
    return moved - F.floor(moved)


def mixing_report(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (words the mix takes of the document, repeats counted)."""
    out = copies(common.cut(with_sizes(docs), "mixing"), weights, most)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source", "source_size", F.round("target", 4).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def identified(docs: DataFrame, work: common.Work, scanned: bool) -> tuple[DataFrame, list[str]]:
    """docs with columns that name each row, the same whenever it is read; and their names."""
    if scanned:
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias("file__"), F.col("_metadata.row_index").alias("row__")), ["file__", "row__"]
        except AnalysisException:
            pass
    return work.keep("documents", docs.withColumn("row__", F.monotonically_increasing_id())), ["row__"]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, copy: str = "copy", scanned: bool = False) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, numbered from 1 in a further column.

    It is named `copy`, with as many underscores as make it differ from the columns that are there. Rows are told apart by where
    they stand, so that rows that repeat a doc_id, or have none, are taken each by itself. `scanned` says that docs is a table as
    read from files, whose rows their files and places name; others are written first.
    """
    while copy.lower() in map(str.lower, docs.columns):
        copy += "_"
    work = common.Work(docs.sparkSession, "mix")
    inner = common.renamed(docs)
    rows, names = identified(inner.df, work, scanned)
    known = rows.select(inner.col("doc_id").alias("doc_id"), inner.col("source").alias("source"), inner.col("text").alias("text"), *names)
    sized = work.keep("sizes", with_sizes(known, ["doc_id", "source", *names]))
    plan = work.keep("plan", copies(sized, weights, most, tuple(names)).where("copies > 0").select(*names, "copies"))
    out = rows.join(plan, names)
    return out.select(*inner.restored(), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(copy))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(common.table(spark, sf_dir, "documents"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS draw
  FROM documents
), ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), substr(draw, 1, 2), size, draw, doc_id) AS DOUBLE) AS place FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END :: DOUBLE AS weight
  FROM sized GROUP BY source
), left_over AS (
  SELECT *, 3 * source_size / weight AS full_at,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM sources WINDOW before AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(left_words / left_weight, full_at) AS x FROM left_over WHERE left_words / left_weight <= full_at
), goals AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, least(3 * source_size, coalesce(weight * x, 3 * source_size)) AS target,
         CAST(('0x' || substr(md5(coalesce(source, '') || ':offset'), 1, 8)) AS BIGINT) / 4294967296.0 :: DOUBLE AS shift
  FROM sources LEFT JOIN level ON true
), each AS (
  SELECT o.doc_id, o.size, o.source, g.source_size, g.target, g.shift, o.place, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS e
  FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source
), turned AS (
  SELECT *, shift + turn / 32.0 :: DOUBLE - floor(shift + turn / 32.0 :: DOUBLE) AS u FROM each, (SELECT unnest(range(32)) AS turn)
), tried AS (
  SELECT *, least(floor(e * place + u) - floor(e * (place - 1) + u), 3) * size AS taken FROM turned
), chosen AS (
  SELECT source, arg_min(turn, (miss, turn)) AS turn
  FROM (SELECT source, turn, abs(sum(taken) - any_value(target)) AS miss FROM tried GROUP BY source, turn) GROUP BY source
)
SELECT t.doc_id, t.size, t.source, t.source_size, round(t.target, 4) AS target, CAST(t.taken AS BIGINT) AS taken
FROM tried t JOIN chosen c ON t.source IS NOT DISTINCT FROM c.source AND t.turn = c.turn
"""
