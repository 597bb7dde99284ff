"""Wildcard names (D3): names looked up by LIKE patterns without a nested loop.

The tracked job matches a candidate's name case-insensitively as a pattern, so
``%`` stands for any run of characters and ``_`` for one; there is no escape
character.  The literal runs of a pattern must occur in a name it matches, and
a run at the pattern's start or end at the name's.  Names are therefore marked
at both ends, each pattern is looked up by the rarest gram of its longest run
in an equi-join, and what is found is verified with LIKE.  Where that would ask
LIKE more often than there are names, patterns with one ``%`` at most are looked up
by all their characters instead, those with wildcards at the same places together
(a mask): a name has one key a mask.  Patterns without a literal ask for a length only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floatline.operators.ranking import first_per_key
from floatline.session import materialize, parallelism

GRAM = 3
FEW_GRAMS = 2000  # strings of up to GRAM characters, put into the plan
# Ends of a name.  A name that holds these characters is found a little more often before LIKE is asked.
START, END = "\x02", "\x03"


def has_wildcard(name: Column) -> Column:
    return name.rlike("[%_]")


def like(name: Column, pattern: Column) -> Column:
    """LIKE without an escape character: ``!`` escapes itself alone.  A run of ``%`` is one."""
    spelled = F.regexp_replace(F.replace(pattern, F.lit("!"), F.lit("!!")), "%+", "%")
    return F.call_function("like", name, spelled, F.lit("!"))


def _all_grams(text: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, n))


def grams(text: Column, n: Column | int) -> Column:
    """The distinct grams of ``n`` characters; none where the text is shorter."""
    return F.array_distinct(_all_grams(text, n))


def _runs(pattern: Column) -> Column:
    """Literal runs of a pattern, those at its ends marked; marks alone are none."""
    marked = F.split(F.concat(F.lit(START), pattern, F.lit(END)), "[%_]+")
    return F.filter(marked, lambda r: (r != "") & (r != START) & (r != END))


def _rarest(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(_p, _mask, _g, _df) of patterns with a literal: the rarest gram of the longest run and the number of
    names that hold it.  A gram no name holds decides its pattern: nothing matches, it has no row."""
    longest = F.array_max(F.transform(F.col("_runs"), lambda r: F.least(F.length(r), F.lit(GRAM))))
    probes = patterns.withColumn("_n", longest).select(
        "_p", F.explode(F.array_distinct(F.flatten(F.transform("_runs", lambda r: grams(r, F.col("_n")))))).alias("_g"))
    # Counted in the map tasks: a gram costs one row a task.
    held = names.select(_marked_grams().alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    seen = probes.hint("merge").join(held, "_g", "left")
    rarest = first_per_key(seen, ["_p"], [F.coalesce("_df", F.lit(0)), F.col("_g")]).where(F.col("_df").isNotNull())
    spelled = F.regexp_replace("_p", "%+", "%")
    return rarest.select("_p", F.regexp_replace(spelled, "[^%_]", "x").alias("_mask"), "_g", "_df")


def _marked_grams(only: list[str] | None = None) -> Column:
    marked = F.concat(F.lit(START), F.col("_name"), F.lit(END))
    every = F.concat(*[_all_grams(marked, n) for n in range(1, GRAM + 1)])
    return F.explode(F.array_distinct(every if only is None else F.filter(every, lambda g: g.isin(only))))


def _by_gram(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(_p, _id) of patterns (_p, _g): the least id among the names matched."""
    few = [r["_g"] for r in patterns.select("_g").distinct().limit(FEW_GRAMS + 1).collect()]
    posted = names.select("_name", "_id", _marked_grams(few if len(few) <= FEW_GRAMS else None).alias("_g"))
    # The least id is kept in the map tasks, so a gram of many names is not shuffled again.
    return (posted.hint("merge").join(patterns.select("_p", "_g"), "_g").where(like(F.col("_name"), F.col("_p")))
            .groupBy("_p").agg(F.min("_id").alias("_id")))


def _literals(segment: Column, shift: Column | int) -> Column:
    """(at, n) of the literal runs of a mask's segment; ``shift`` is added to their places."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(segment), F.lit(1))), lambda i: (F.substring(segment, i, F.lit(1)) == "x")
                  & ((i == 1) | (F.substring(segment, i - 1, F.lit(1)) != "x")))
    return F.transform(at, lambda i: F.struct((i + shift).alias("at"), F.length(F.regexp_extract(F.substr(segment, i), "^x+", 0)).alias("n")))


def _by_mask(patterns: DataFrame, masks: DataFrame, names: DataFrame, partitions: int) -> DataFrame:
    """(_p, _id) of patterns with one ``%`` at most: their literals stand at places counted from a name's start
    or end, so the patterns of one mask (``_mask``, literals written as x) ask for equal characters at equal places."""
    head, tail = (F.split("_mask", "%")[0], F.coalesce(F.get(F.split("_mask", "%"), F.lit(1)), F.lit("")))
    places = materialize(masks.select("_mask", F.col("_mask").contains("%").alias("_open"), (F.length(head) + F.length(tail)).alias("_len"),
                          F.concat(_literals(head, 0), _literals(tail, -1 - F.length(tail))).alias("_at")))
    runs = places.agg(F.max(F.size("_at"))).first()[0] or 0
    # Every name meets every mask: both are dealt by a number, of which a mask has each.
    numbers = 4 * partitions
    places = places.withColumn("_number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(numbers - 1).cast("long"))))
    dealt = names.withColumn("_number", F.pmod(F.xxhash64("_name"), F.lit(numbers))).repartition(partitions, "_number")
    met = dealt.hint("merge").join(places, "_number").where(
        (F.length("_name") == F.col("_len")) | (F.col("_open") & (F.length("_name") > F.col("_len"))))
    run = lambda r: F.substring(F.col("_name"), r["at"], r["n"])
    # Spelled out for a few runs, as it is compiled then; a run that a mask lacks is null.
    key = F.concat_ws("", *[run(F.get("_at", F.lit(i))) for i in range(runs)] if runs <= 16 else [F.transform("_at", run)])
    held = met.groupBy("_mask", key.alias("_key")).agg(F.min("_id").alias("_id"))
    asked = patterns.select("_p", "_mask", F.regexp_replace("_p", "[%_]", "").alias("_key"))
    return asked.hint("merge").join(held, ["_mask", "_key"]).select("_p", "_id")


def _by_length(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """(_p, _id) of patterns made of wildcards alone: ``_`` sets the length, ``%`` makes it the least length."""
    least = F.length(F.regexp_replace("_p", "%", "")).alias("_len")
    lengths = names.groupBy(F.length("_name").alias("_len")).agg(F.min("_id").alias("_id"))
    exact = patterns.where(~F.col("_p").contains("%")).select("_p", least).join(lengths.hint("merge"), "_len").select("_p", "_id")
    open_ = patterns.where(F.col("_p").contains("%")).select("_p", least)
    # One row a distinct length: the least id among the names at least as long.
    steps = lengths.unionByName(open_.select("_len", F.lit(None).cast("long").alias("_id")).distinct()) \
        .groupBy("_len").agg(F.min("_id").alias("_id"))
    longer = steps.select("_len", F.min("_id").over(Window.orderBy(F.desc("_len"))).alias("_id"))
    return exact.unionByName(open_.join(longer.hint("merge"), "_len").where(F.col("_id").isNotNull()).select("_p", "_id"))


def least_match(patterns: DataFrame, names: DataFrame) -> DataFrame:
    """For every distinct pattern ``_p`` the least ``_id`` of the names
    (``_name``, ``_id``) it matches; patterns that match nothing have no row.

    Both are compared as given: lower them for a match without case.  All joins
    shuffle: by its file size Spark takes a table of names, or their grams, for
    small enough to go through the driver."""
    spark = patterns.sparkSession
    partitions = max(2 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Dealt out by number: short rows that make much work would else be put in few tasks.
    p = patterns.select("_p").where(F.col("_p").isNotNull()).distinct().repartition(partitions, "_p").withColumn("_runs", _runs(F.col("_p")))
    named = materialize(names.where(F.col("_name").isNotNull()).groupBy("_name").agg(F.min("_id").alias("_id")).repartition(partitions, "_name"))
    literal = materialize(_rarest(p.where(F.size("_runs") > 0), named))
    # By mask costs a key a name and mask, by gram LIKE for each name that holds a pattern's gram.
    masks = (literal.where(F.size(F.split("_mask", "%")) <= 2).groupBy("_mask").agg(F.sum("_df").alias("_cost"))
             .where(F.col("_cost") > F.lit(named.count())).select("_mask"))
    other = literal.hint("merge").join(masks, "_mask", "left_anti")
    return (_by_gram(other, named)
            .unionByName(_by_mask(literal.hint("merge").join(masks, "_mask", "left_semi"), masks, named, partitions))
            .unionByName(_by_length(p.where(F.size("_runs") == 0).select("_p"), named)))
