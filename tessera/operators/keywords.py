"""The most frequent words of groups: exact counts, and sketches of them that merge, so that a group of groups needs no text again.

A sketch holds a group's most frequent words, a row each:

    by, word, n, over, first, lost

The word occurs n to n + over times in the group, first at `first`; a word without a row occurs `lost` times at most. Sketches of
parts merge by sums. `exact` counts the few words of a merged sketch that may be among the k most frequent in the texts; where a sketch
can't rule out other words, all words of that group are counted.

Cases: null or empty texts and texts of stop words alone have no words, and a group of them has no rows; null is a group; equal counts stand
by first occurrence, rows that repeat an order key count as one text as to that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.functions import text as T
from tessera.operators.arrow import cut

KEYWORDS, SHORTEST = 10, 4
#: Words that a group's sketch holds, and rows of candidates that are sent to all executors.
HELD, SENT = 64, 100_000


def occurrences(rows: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """by, order, at, word: words of 4 letters or more that aren't stop words."""
    each = rows.select(by, order, F.posexplode(T.words(F.col(text))).alias("at", "word"))
    return each.where((F.length("word") >= SHORTEST) & ~F.col("word").isin(T.STOP_WORDS))


def counted(each: DataFrame, by: str, order: str) -> DataFrame:
    """by, word, n, first of occurrences: how often, and where first (by order, then place in the text).

    Numbers are aggregated, which hash and combine before the one shuffle. An order that is no integer needs two: a text, then a group.
    """
    if isinstance(each.schema[order].dataType, t.IntegralType):
        place = F.col(order).cast("decimal(20,0)") * F.lit(1 << 31) + F.col("at")
        return each.groupBy(by, "word").agg(F.count("*").alias("n"), F.min(place.cast("decimal(38,0)")).alias("first"))
    in_text = each.groupBy(by, order, "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    out = in_text.groupBy(by, "word").agg(F.sum("n").alias("n"), F.min(order).alias("__order"), F.min_by("at", order).alias("at"))
    return out.select(by, "word", "n", F.struct("__order", "at").alias("first"))


def placed(rows: DataFrame, order: str) -> DataFrame:
    """rows and `place`, an integer for each order key, greater for a greater key: counting by it takes one shuffle of numbers.

    Keys are dealt by range and numbered where they lie. Made for narrow rows (no texts), which are written.
    """
    keys = rows.select(order).distinct().repartitionByRange(order).sortWithinPartitions(order)
    return cut(rows.join(keys.withColumn("place", F.monotonically_increasing_id()), order), "places")


def ranked(counts: DataFrame, by: str, k: int) -> DataFrame:
    """by, rank, word, n of the k most frequent."""
    best = Window.partitionBy(by).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(by, "rank", "word", "n")


def keywords(rows: DataFrame, by: str, order: str, k: int = KEYWORDS, text: str = "text") -> DataFrame:
    """by, rank, word, n: the k most frequent words over 3 letters that aren't stop words; ties by first occurrence."""
    return ranked(counted(occurrences(rows, by, order, text), by, order), by, k)


def same(a: str, b: str) -> F.Column:
    return F.col(a).eqNullSafe(F.col(b))


def held(bounds: DataFrame, by: str, most: int) -> DataFrame:
    """The sketch of bounds (by, word, n, over, first, lost): `most` words a group; the next one raises `lost`."""
    best = Window.partitionBy(by).orderBy(F.desc(F.col("n") + F.col("over")), "first", "word")
    some = bounds.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= most + 1)
    next_one = F.max(F.when(F.col("__rank") > most, F.col("n") + F.col("over"))).over(Window.partitionBy(by))
    out = some.withColumn("lost", F.greatest("lost", F.coalesce(next_one, F.lit(0)))).where(F.col("__rank") <= most)
    return out.select(by, "word", "n", "over", "first", "lost")


def sketch(rows: DataFrame, by: str, order: str, most: int = HELD, text: str = "text") -> DataFrame:
    """The sketch of each group's texts; what it holds is exact."""
    counts = counted(occurrences(rows, by, order, text), by, order)
    zero = F.lit(0).cast("long")
    return held(counts.select(by, "word", "n", zero.alias("over"), "first", zero.alias("lost")), by, most)


def merged(sketches: DataFrame, part: str, by: str, most: int = HELD) -> DataFrame:
    """The sketch of groups from those of their parts; `part` names a row's part and `by` the group that it belongs to.

    A word that a part's sketch doesn't hold may occur there as often as the part has lost.
    """
    lost = sketches.groupBy(by, part).agg(F.max("lost").alias("lost")).groupBy(by).agg(F.sum("lost").alias("__all"))
    sums = sketches.groupBy(by, "word").agg(F.sum("n").alias("n"), F.sum("over").alias("over"), F.sum("lost").alias("__known"), F.min("first").alias("first"))
    both = sums.join(lost.withColumnRenamed(by, "__group"), same(by, "__group"))
    return held(both.select(by, "word", "n", (F.col("over") + F.col("__all") - F.col("__known")).alias("over"), "first", F.col("__all").alias("lost")), by, most)


def candidates(sketched: DataFrame, by: str, k: int = KEYWORDS) -> DataFrame:
    """by, word, closed: words that may be among a group's k most frequent. Unless the group is closed, others may be too."""
    sure = Window.partitionBy(by).orderBy(F.desc("n"), "word")
    bar = F.max(F.when(F.col("__rank") == k, F.col("n"))).over(Window.partitionBy(by))
    out = sketched.withColumn("__rank", F.row_number().over(sure)).withColumn("__bar", F.coalesce(bar, F.lit(0)))
    out = out.where(F.col("n") + F.col("over") >= F.col("__bar"))
    return out.select(by, "word", ((F.col("lost") == 0) | (F.col("lost") < F.col("__bar"))).alias("closed"))


def exact(rows: DataFrame, sketched: DataFrame, by: str, order: str, k: int = KEYWORDS, text: str = "text") -> DataFrame:
    """As `keywords`, of rows whose groups are sketched (a written table: it is read more than once).

    Candidates are sent to the texts if they are few; else words are counted first and only then met with them.
    """
    found = candidates(sketched, by, k)
    closed = found.where("closed").select(F.col(by).alias("__group"), F.col("word").alias("__word"))
    is_one = same(by, "__group") & (F.col("word") == F.col("__word"))
    each = occurrences(rows, by, order, text)
    if closed.count() <= SENT:
        counts = counted(each.join(F.broadcast(closed), is_one, "left_semi"), by, order)
    else:
        counts = counted(each, by, order).join(closed, is_one, "left_semi")
    open_ = found.where("NOT closed").select(F.col(by).alias("__group")).distinct()
    if not open_.isEmpty():
        counts = counts.unionByName(counted(occurrences(rows.join(open_, same(by, "__group"), "left_semi"), by, order, text), by, order))
    return ranked(counts, by, k)
