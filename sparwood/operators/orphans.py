"""References to records that do not exist, or did not at the time (problem 5).

Keys are dictionary-encoded per key range as small integers, every range and month gets a bitmap of the keys referred to
and one of the keys that existed all through the month, and reference AND NOT parent leaves the bits to look at. Bitmaps
are kept compressed, as the non-zero 64-bit words only, and built by bit_or with partial aggregation. Surviving bits are
decoded and their references checked to the microsecond against the parents' times.

Ranges are hashes of the key, as many as the number of keys asks for, so that no distribution of keys makes one large; a
hot key is reduced to one bit per month before any shuffle. In the exact check parents' times are reduced to islands per day
and to a prefix maximum over days; references meet these in joins on key and day and are never gathered.

Defined results: null keys refer to nothing. A reference without time meets no parent and has a null month. A parent row
without arrival never existed, but its id isn't missing. Repeated rows are reported each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored, table

#: Keys per range of the dictionary, about.
RANGE_KEYS = 1 << 18
_FOREVER = "timestamp_ntz'9999-12-31 00:00:00'"


def _month(t: Column) -> Column:
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def _word(c: str = "code") -> Column:
    return F.shiftright(F.col(c), 6).cast("int")


def _bit(c: str = "code") -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(c) % 64).cast("int"))


def dictionary(keys: DataFrame, ranges: int) -> DataFrame:
    """Distinct keys with a range (by hash) and a dense code within it: id, rng, code."""
    d = keys.where(F.col("id").isNotNull()).distinct().withColumn("rng", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
    return d.withColumn("code", (F.row_number().over(Window.partitionBy("rng").orderBy("id")) - 1).cast("int"))


def bitmaps(coded: DataFrame) -> DataFrame:
    """rng, month, word, bits from rng, month, code: the non-zero words of one bitmap per range and month."""
    return coded.groupBy("rng", "month", _word().alias("word")).agg(F.expr("bit_or(bit)").alias("bits"))


def and_not(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Words of the references' bitmaps without the parents' bits; words left empty are dropped."""
    p = parents.withColumnRenamed("bits", "held")
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(F.col("held"), F.lit(0).cast("long"))))
    return refs.join(p, ["rng", "month", "word"], "left").select("rng", "month", "word", left.alias("bits")).where("bits != 0")


def decode(words: DataFrame) -> DataFrame:
    """rng, month, code of every set bit."""
    one = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("bits"), i) == 1)
    return words.select("rng", "month", F.explode(one).alias("b"), "word").select("rng", "month", (F.col("word") * 64 + F.col("b")).cast("int").alias("code"))


def orphans(refs: DataFrame, parents: DataFrame, ranges: int | None = None) -> DataFrame:
    """Unmet references with a reason: the columns ref_table, ref_column, ref_no, id, t of refs and reason.

    parents: id, since, until (null: for ever). A reference is met by a parent row of its id with since <= t < until;
    the reason is missing (no row of that id), late (the earliest since is after t) or deleted.
    """
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    refs = refs.where(F.col("id").isNotNull()).withColumn("t", ntz("t"))
    spans = parents.where(F.col("id").isNotNull()).select("id", ntz("since").alias("since"), F.coalesce(ntz("until"), F.expr(_FOREVER)).alias("until"))
    spans = spans.groupBy("id", "since").agg(F.max("until").alias("until"))
    asked = stored(refs.groupBy("id", _month(F.col("t")).alias("month")).count(), "asked")
    months = asked.agg(F.min("month").alias("lo"), F.max("month").alias("hi"), F.approx_count_distinct("id").alias("n")).first()
    keys = months["n"] + spans.agg(F.approx_count_distinct("id")).first()[0]
    ranges = ranges or max(256, keys // RANGE_KEYS)
    coded = stored(dictionary(asked.select("id").unionByName(spans.select("id")), ranges), "dictionary")
    lo, hi = (months["lo"], months["hi"]) if months["lo"] is not None else (0, -1)
    # Whole months of life: from the month after the arrival to the one before the removal. Boundary months go on to the exact check.
    first = F.greatest(_month(F.col("since")) + F.when(F.col("since") > F.date_trunc("month", F.col("since")).cast("timestamp_ntz"), 1).otherwise(0), F.lit(lo))
    last = F.least(_month(F.col("until")) - 1, F.lit(hi))
    whole = spans.where(F.col("since").isNotNull()).select("id", first.alias("first"), last.alias("last")).where("first <= last")
    whole = whole.join(coded, "id").select("rng", "code", F.explode(F.sequence("first", "last")).alias("month")).withColumn("bit", _bit())
    wanted = asked.where(F.col("month").isNotNull()).join(coded, "id").select("rng", "code", "month").withColumn("bit", _bit())
    doubtful = decode(and_not(bitmaps(wanted), bitmaps(whole))).join(coded, ["rng", "code"]).select("id", "month")
    doubtful = stored(doubtful.unionByName(asked.where(F.col("month").isNull()).select("id", "month")), "doubtful")
    return _exact(refs, spans, doubtful)


def _exact(refs: DataFrame, spans: DataFrame, doubtful: DataFrame) -> DataFrame:
    """References of the doubtful (id, month) that no span meets."""
    keys = doubtful.select("id").distinct()
    spans = spans.join(keys, "id", "left_semi")
    r = refs.withColumn("month", _month(F.col("t"))).alias("r")
    met = (F.col("r.id") == F.col("d.id")) & F.col("r.month").eqNullSafe(F.col("d.month"))
    r = r.join(doubtful.alias("d"), met, "left_semi").drop("month")
    r = r.withColumn("day", F.to_date("t"))
    known = spans.groupBy("id").agg(F.min("since").alias("earliest"), F.lit(True).alias("known"))
    spans = spans.where(F.col("since").isNotNull()).withColumn("day", F.to_date("since"))
    # The longest reach of all days before, by a prefix maximum over the days of an id.
    daily = spans.groupBy("id", "day").agg(F.max("until").alias("reach"))
    asked = r.where(F.col("t").isNotNull()).select("id", "day").distinct().withColumn("reach", F.lit(None).cast("timestamp_ntz"))
    days = daily.unionByName(asked).groupBy("id", "day").agg(F.max("reach").alias("reach"))
    earlier = F.max("reach").over(Window.partitionBy("id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("id", "day", earlier.alias("earlier"))
    # The spans that begin on a day, merged to islands: what begins within the reach of those before belongs to them.
    by = Window.partitionBy("id", "day").orderBy("since")
    reach = F.max("until").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("since") > reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(by)).groupBy("id", "day", "island").agg(F.min("since").alias("since"), F.max("until").alias("until"))
    # References are never sorted or gathered by key: they meet a day's reach and islands in joins, whose hot keys AQE splits.
    held = r.alias("r").join(
        islands.alias("i"), (F.col("r.id") == F.col("i.id")) & (F.col("r.day") == F.col("i.day")) & (F.col("r.t") >= F.col("i.since")) & (F.col("r.t") < F.col("i.until")), "left_anti"
    )
    unmet = held.join(days, ["id", "day"], "left").where(F.col("t").isNull() | ~F.coalesce(F.col("earlier") > F.col("t"), F.lit(False))).join(known, "id", "left")
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("earliest") > F.col("t"), "late").otherwise("deleted")
    return unmet.select("ref_table", "ref_column", "ref_no", "id", "t", reason.alias("reason"))


def p5_orphans(spark: SparkSession, folder: str) -> DataFrame:
    e, w, s = (table(spark, folder, t) for t in ("ecotones", "weather_eraldis", "eraldis"))
    one = lambda df, name, column, no, t: df.select(F.lit(name).alias("ref_table"), F.lit(column).alias("ref_column"), F.col(no).alias("ref_no"), F.col(column).alias("id"), F.col(t).alias("t"))
    refs = [one(e, "ecotones", "id_a", "ecotone_no", "computed_at"), one(e, "ecotones", "id_b", "ecotone_no", "computed_at"), one(w, "weather_eraldis", "id", "weather_no", "as_of")]
    return orphans(reduce(DataFrame.unionByName, refs), s.select("id", F.col("arrived_at").alias("since"), F.col("removed_at").alias("until")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """ref_table, ref_column, ref_no, ref_month, reason of every unmet reference."""
    return p5_orphans(spark, folder).select("ref_table", "ref_column", "ref_no", F.date_format("t", "yyyy-MM").alias("ref_month"), "reason")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Unmet references and the different ids among them, by table, column, month and reason."""
    found = p5_orphans(spark, folder).withColumn("ref_month", F.date_format("t", "yyyy-MM"))
    return found.groupBy("ref_table", "ref_column", "ref_month", "reason").agg(F.count("*").alias("refs"), F.countDistinct("id").alias("ids"))
