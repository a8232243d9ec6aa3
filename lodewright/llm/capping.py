"""Problem 3: capping the records of dominant contributors by parallel bisection.

Per contributor a bracket ``[lo, hi)`` of scores holds the cutoff. Each round cuts every bracket into
equal steps and counts, for all contributors together, the records above every step (a map-side
combined aggregation on contributor and step, so a contributor with a third of all rows never meets
in one task). Once the cutoff of a contributor is a single score, or its bracket holds few records,
the records on the boundary are ordered by identifier; a boundary of many equal scores is bisected by
identifier in the same way.

Defined results: scores that are null, NaN or outside the valid range rank last, equal among
themselves. Rows of a null contributor are outside the operator (neither kept nor cut). Null
identifiers rank after all others; of rows that agree in contributor, score and identifier any may
be kept, the number kept is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewright.llm.common import reliable

STEPS = 64
SMALL = 1000  # a boundary of so few records is ordered outright
MAX_BROADCAST_ROWS = 100_000  # of about 50 bytes each


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def valid_score(score: Column, low: float, high: float) -> Column:
    """The score, or a value below the range for null, NaN and scores out of range."""
    ok = score.isNotNull() & ~F.isnan(score) & (score >= low) & (score <= high)
    return F.when(ok, score).otherwise(F.lit(low - 1.0))


def _bisect(rows: DataFrame, want: DataFrame, value: str, low: float, high: float, whole: bool) -> DataFrame:
    """Boundary of each contributor of ``want`` (``who, want``) on ``value``, larger first.

    Returns ``who, lo, hi, want``: records with value >= hi are in; ``want`` more are to be taken
    among those in [lo, hi), which are at most ``SMALL`` or all equal. ``whole``: values are integers.
    """
    end = high + 1 if whole else high * (1 + 1e-12) + 1e-12
    kind = "bigint" if whole else "double"
    state = reliable(want.select("who", "want", F.lit(low).cast(kind).alias("lo"), F.lit(end).cast(kind).alias("hi")))
    done = None
    while (open_n := state.count()) > 0:
        hit = rows.join(_maybe_broadcast(state, open_n), "who").where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")))
        width = (F.col("hi") - F.col("lo")).cast("double")
        step = F.least(F.lit(STEPS - 1), F.floor((F.col(value) - F.col("lo")).cast("double") / width * STEPS)).cast("int")
        counts = hit.groupBy("who", "want", step.alias("step")).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
        # At most STEPS rows a contributor.
        above = Window.partitionBy("who").orderBy(F.desc("step"))
        ranked = counts.withColumn("upto", F.sum("n").over(above.rowsBetween(Window.unboundedPreceding, 0)))
        edge = ranked.where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want")))
        # The bracket shrinks to the values seen in the step that holds the cutoff.
        new = edge.select("who", (F.col("want") - F.col("upto") + F.col("n")).alias("want"), F.col("least").cast(kind).alias("lo"), F.col("most").cast(kind).alias("most"), "n")
        new = reliable(new)
        settled = (F.col("n") <= SMALL) | (F.col("lo") == F.col("most"))
        part = new.where(settled).select("who", "lo", F.col("most").alias("hi"), "want")
        done = part if done is None else done.unionByName(part)
        top = F.col("most") + 1 if whole else F.col("most") + F.greatest(F.abs(F.col("most")) * 1e-15, F.lit(1e-300))
        state = reliable(new.where(~settled).select("who", "want", "lo", top.alias("hi")))
    return done if done is not None else state.select("who", "lo", "hi", "want")


def cap(
    df: DataFrame, *, who: Column, score: Column, identifier: Column, eligible: Column, limit: int = 8, share: float | None = None,
    score_range: tuple[float, float] = (0.0, 5.0),
) -> DataFrame:
    """Cut each contributor to ``limit`` records (or to ``share`` of all eligible ones, if that is less).

    Returns ``who, id, kept`` for each eligible row with a contributor.
    """
    low, high = score_range
    rows = df.where(eligible & who.isNotNull()).select(who.alias("who"), valid_score(score, low, high).alias("v"), identifier.cast("bigint").alias("id"))
    # Contributor names are shortened to 128 bits so that rounds move little.
    sizes = rows.groupBy("who").agg(F.count("*").alias("n"))
    if share is not None:
        limit = min(limit, int((rows.count()) * share))
    over = reliable(sizes.where(F.col("n") > limit).select("who", F.lit(limit).cast("bigint").alias("want")))
    n_over = over.count()
    held = rows.join(_maybe_broadcast(over.select("who"), n_over), "who", "left_semi")
    if limit <= 0:
        return rows.select("who", "id", F.lit(False).alias("kept"))
    cut = reliable(_bisect(held, over, "v", low - 1.0, high, False))
    # Rows between the bounds that are all equal and many: bisect them by identifier (lower first).
    n_cut = cut.count()
    at = rows.join(_maybe_broadcast(cut, n_cut), "who", "left")
    edge = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    on_edge = held.join(_maybe_broadcast(cut, n_cut), "who").where(edge)
    many = reliable(on_edge.groupBy("who", "want").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("who", "want"))
    n_many = many.count()
    neg = F.coalesce(-F.col("id"), F.lit(-(1 << 62)))
    if n_many:
        ties = on_edge.drop("want").join(_maybe_broadcast(many.select("who"), n_many), "who", "left_semi").select("who", neg.alias("neg"))
        span = ties.agg(F.min("neg").alias("a"), F.max("neg").alias("b")).first()
        by_id = reliable(_bisect(ties, many, "neg", span["a"], span["b"], True))
    else:
        by_id = many.select("who", F.lit(0).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi"), "want")
    by_id = by_id.select("who", F.col("lo").alias("id_lo"), F.col("hi").alias("id_hi"), F.col("want").alias("id_want"))
    at = at.join(_maybe_broadcast(by_id, n_many), "who", "left").withColumn("neg", neg)
    tied = F.col("id_lo").isNotNull()
    # sure: kept without a look at others; open: on the boundary, few per contributor.
    at = at.withColumn(
        "side",
        F.when(F.col("lo").isNull() | (F.col("v") > F.col("hi")), 1).when(F.col("v") < F.col("lo"), -1)
        .when(tied & (F.col("neg") > F.col("id_hi")), 1).when(tied & (F.col("neg") < F.col("id_lo")), -1).otherwise(0),
    )
    order = Window.partitionBy("who").orderBy(F.desc("v"), F.desc("neg"))
    last = at.where("side = 0").withColumn("rn", F.row_number().over(order)).select("who", "id", (F.col("rn") <= F.coalesce("id_want", "want")).alias("kept"))
    return at.where("side <> 0").select("who", "id", (F.col("side") > 0).alias("kept")).unionByName(last)
