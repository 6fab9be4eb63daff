"""Stacks as logs of pushes and pops, matched like parentheses by running sums. One stack's log may be the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.plans.numbering import last_known, running_sum


def levels(log: DataFrame, *, stack: str = "stack", seq: str = "seq", op: str = "op") -> DataFrame:
    """The log with depth (elements after the operation), __level (of the element pushed or popped) and underflow.

    A pop from an empty stack changes nothing and is marked.
    """
    step = F.when(F.col(op) == "push", 1).otherwise(-1)
    run = running_sum(log.withColumn("__step", step), [stack], [seq], "__step", "__r", low="__low", prior="__prior")
    run = run.withColumn("__low", F.least(F.lit(0), "__low")).withColumn("__prior", F.least(F.lit(0), "__prior"))
    run = run.withColumn("depth", F.col("__r") - F.col("__low"))
    # A pop from an empty stack is a new low of the running sum.
    run = run.withColumn("underflow", (F.col(op) == "pop") & (F.col("__r") == F.col("__low")) & (F.col("__prior") > F.col("__low")))
    return run.withColumn("__level", F.when(F.col(op) == "push", F.col("depth")).otherwise(F.col("depth") + 1)).drop("__r", "__low", "__prior", "__step")


def pops(log: DataFrame, *, stack: str = "stack", seq: str = "seq", op: str = "op", value: str = "value", strict: bool = False) -> DataFrame:
    """Each pop (stack, seq, value, underflow) with the value it takes. strict: a pop from an empty stack is an error."""
    told = levels(log, stack=stack, seq=seq, op=op)
    if strict and not told.filter("underflow").isEmpty():
        raise IndexError("pop from an empty stack")
    pushed = F.when(F.col(op) == "push", F.struct(F.col(value).alias("v")))
    real = last_known(told.filter("not underflow").withColumn("__pushed", pushed), [stack, "__level"], [seq], "__pushed", "__last")
    real = real.withColumn("__v", F.col("__last.v"))
    return real.filter(F.col(op) == "pop").select(stack, seq, F.col("__v").alias(value), F.lit(False).alias("underflow")).unionByName(told.filter("underflow").select(stack, seq, F.lit(None).cast(log.schema[value].dataType).alias(value), F.lit(True).alias("underflow")))


def remains(log: DataFrame, *, stack: str = "stack", seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """What is left at the end: (stack, level, value), level 1 at the bottom."""
    told = levels(log, stack=stack, seq=seq, op=op).filter("not underflow")
    last = told.groupBy(stack, "__level").agg(F.max_by(F.struct(F.col(op).alias("o"), F.col(value).alias("v")), seq).alias("x"))
    return last.filter("x.o = 'push'").select(stack, F.col("__level").alias("level"), F.col("x.v").alias(value))


def depths(log: DataFrame, *, stack: str = "stack", seq: str = "seq", op: str = "op") -> DataFrame:
    """Each stack's number of elements at the end."""
    told = levels(log, stack=stack, seq=seq, op=op)
    return told.groupBy(stack).agg(F.max_by("depth", seq).alias("depth"))
