"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

The rates closest in relative entropy to one copy of each document, at most ``cap`` and with given token totals, are
exponential tilts: rate(size) = min(cap, exp(lambda[source] * size / mean[source])). The dual is convex, one unknown for
each source; Newton's steps, kept inside a bracket, find all of them together. Each step is one aggregation of the
histogram of sizes by source, which is all that the rates depend on, so documents are read once, not once a step.

Rates become copies by systematic rounding along the sizes of a source: the n-th copy is due where the running sum of
rates passes n - u. Of 64 offsets u each source takes the one whose token total comes nearest its target. Documents of
one source and size are placed by a hash of their id, in parts whose number grows with the table; a part's place in the
running sum comes from the counts of the parts before it, so no task sees a whole source or a whole size.

All sums that decide something are integers or decimals, so reruns agree whatever the order of the rows.

Defined results: a null text has size 0; documents of size 0 have rate 1; a null source is a source of its own, last in
order; repeated rows are documents in their own right; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import discard, materialize

#: What a word is, and the weights that sources take in turn.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Rates are kept as integers in this unit.
UNIT = 1_000_000_000
#: Documents of one source and size in a part, about.
PART = 50_000
OFFSETS = 64
MAX_STEPS = 80


def sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (id, key, size): key is the source behind an 's', or 'n' for null, so that keys are never null."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    return docs.select(F.col(id_col).alias("id"), key.alias("key"), size.alias("size"))


def targets(hist: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Rows (key, source_size, target) for the sources of a histogram (key, size, n). One row a source, so its global orders are small."""
    per = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("key") == "n", "key")) - 1
    w = F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w)
    # Filled like basins: the sources that meet their cap come first when ordered by size over weight.
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("key") == "n", "key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    level = (share * F.sum("source_size").over(whole) - cap * before("source_size")) / (F.sum("w").over(whole) - before("w"))
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= cap * F.col("source_size"))
    at = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("w"), F.col("key") == "n", F.col("key"), F.col("level")))).over(whole)["level"]
    return per.select("key", "source_size", F.least(F.col("w") * F.coalesce(at, F.lit(0.0)), (cap * F.col("source_size")).cast("double")).alias("target"))


def _rate(tilt: F.Column, cap: int) -> F.Column:
    """The rate in units, capped before exp could overflow."""
    return F.round(F.least(F.lit(float(cap)), F.exp(F.least(tilt, F.lit(50.0)))) * UNIT).cast("long")


def tilts(hist: DataFrame, goal: DataFrame, *, cap: int = 2, tolerance: float = 1e-9, max_steps: int = MAX_STEPS) -> DataFrame:
    """Rows (key, mean, lam, full): the dual's solution; full where the cap itself is the target."""
    some = hist.filter("size > 0")
    facts = some.groupBy("key").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    state = goal.join(facts, "key", "left").withColumn("mean", F.greatest(F.col("source_size") / F.coalesce("docs", F.lit(1)), F.lit(1.0)))
    x = F.coalesce("least", F.lit(1)) / F.col("mean")
    full = (F.col("target") >= cap * F.col("source_size")) | (F.col("target") <= 0)
    up = F.col("target") > F.col("source_size")
    # At the bracket's ends even the shortest document has the cap, or is thin enough for the target.
    state = state.select("key", "source_size", "target", "mean", full.alias("full"), F.lit(0.0).alias("lam"), F.when(up, 0.0).otherwise(F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.greatest("source_size", F.lit(1))) / x).alias("lo"), F.when(up, F.log(F.lit(float(cap))) / x).otherwise(0.0).alias("hi"), F.lit(False).alias("done"))
    state = materialize(state, "tilts")
    for _ in range(max_steps):
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        # sums in decimals: the same whatever the order
        got = some.join(state.filter("not full and not done").select("key", "lam", "mean"), "key").select("key", "size", "mean", tilt.alias("tilt"), (F.col("size") * F.col("n")).cast("decimal(38,0)").alias("words"), _rate(tilt, cap).alias("r"))
        slope = F.when(F.exp(F.least("tilt", F.lit(50.0))) < cap, F.round(F.col("r") * F.col("size") / F.col("mean")).cast("decimal(25,0)")).otherwise(F.lit(0).cast("decimal(25,0)"))
        sums = got.groupBy("key").agg(F.sum((F.col("words") * F.col("r").cast("decimal(19,0)")).cast("decimal(38,0)")).cast("double").alias("f"), F.sum((F.col("words").cast("decimal(19,0)") * slope.cast("decimal(19,0)")).cast("decimal(38,0)")).cast("double").alias("d"))
        s = state.join(sums, "key", "left").withColumn("f", F.col("f") / UNIT - F.col("target")).withColumn("d", F.col("d") / UNIT)
        s = s.withColumn("lo", F.when(F.col("f") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.try_divide("f", "d")  # null where all documents have the cap
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        near = F.col("full") | F.col("done") | F.col("f").isNull() | (F.abs("f") <= tolerance * F.col("target")) | (F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.abs("lam"), F.lit(1e-6)))
        step = F.when(near, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = materialize(s.select("key", "source_size", "target", "mean", "full", step.alias("lam"), "lo", "hi", near.alias("done")), "tilts")
        discard(state)
        state = after
        if state.filter("not done").isEmpty():
            break
    return state


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """Rows (id, key, size, source_size, target, copies, taken), one for each row of docs."""
    base = sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    rows = materialize(base, "sizes")
    hist = materialize(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "sizes")
    goal = materialize(targets(hist, weights=weights, share=share, cap=cap), "targets")
    state = tilts(hist, goal, cap=cap)
    dec = lambda c: c.cast("decimal(38,0)")
    rate = F.when(F.col("size") == 0, F.lit(UNIT)).when(F.col("full"), F.when(F.col("target") > 0, F.lit(cap * UNIT)).otherwise(F.lit(UNIT))).otherwise(_rate(F.col("lam") * F.col("size") / F.col("mean"), cap))
    rated = hist.join(state.select("key", "source_size", "target", "mean", "lam", "full"), "key").withColumn("rate", rate.cast("long"))
    along = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    rated = rated.withColumn("past", F.sum((dec(F.col("n")) * F.col("rate")).cast("decimal(38,0)")).over(along)).withColumn("from", dec(F.col("past") - dec(F.col("n")) * F.col("rate")))
    rated = materialize(rated.select("key", "size", "n", "source_size", "target", "rate", "from"), "rates")
    whole = lambda place, u: F.floor((place + u) / UNIT).cast("long")
    offset = F.explode(F.array(*[F.lit(UNIT * j // OFFSETS).cast("long") for j in range(OFFSETS)])).alias("u")
    tried = rated.select("key", "size", "n", "rate", "from", "target", offset)
    made = whole(F.col("from") + dec(F.col("n")) * F.col("rate"), F.col("u")) - whole(F.col("from"), F.col("u"))
    miss = tried.groupBy("key", "u").agg(F.abs(F.sum(dec(made * F.col("size"))).cast("double") - F.first("target")).alias("miss"))
    chosen = materialize(miss.groupBy("key").agg(F.min(F.struct("miss", "u"))["u"].alias("u")), "offsets")
    # Places of documents within their source and size, by parts.
    parts = rows.count() // PART + 1
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part") if parts > 1 else F.lit(0).cast("long").alias("part")
    dealt = rows.select("id", "key", "size", part)
    counts = dealt.groupBy("key", "size", "part").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).join(rated, ["key", "size"]).join(chosen, "key")
    placed = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("id", F.lit(1)), "id")))
    out = placed.join(starts, ["key", "size", "part"])
    here = F.col("from") + dec(F.col("before") + F.col("rank")) * F.col("rate")
    copies = whole(here, F.col("u")) - whole(here - F.col("rate"), F.col("u"))
    return out.select("id", "key", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
