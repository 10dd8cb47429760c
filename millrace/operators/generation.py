"""Query sets built from attempts slot by slot, and the audit of an arm's accepted rows against what they must have been."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import labels
from .tables import written

#: How far the seeds of two passages are apart.
SEED_STEP = 1000
_ACCEPTED = "array<struct<slot:int,attempt:int,seed:bigint,text:string,duplicate:boolean>>"


def query_sets(attempts: DataFrame, group: str, slots: int, most: int, seed: Column | int, preserve: bool = False) -> DataFrame:
    """attempts(group, slot from 0, attempt from 1, text, key) -> (group, accepted, attempts, duplicates, invalid, exhausted).

    Slots are filled in order. An attempt is made only while its slot is empty; a null text is invalid; a key that an accepted text of
    the group has is a duplicate and refused, or with `preserve` accepted and marked. exhausted: not every slot is filled. An attempt's
    seed is `seed` + slot * most + attempt - 1. Attempts beyond `most` and slots beyond `slots` are not made. The state goes through a
    group's few attempts in one expression."""
    made = attempts.where((F.col("attempt") >= 1) & (F.col("attempt") <= most) & (F.col("slot") >= 0) & (F.col("slot") < slots))
    base = F.lit(seed) if isinstance(seed, int) else seed
    own = base.cast("long") + F.col("slot") * most + F.col("attempt") - 1
    rows = made.select(F.col(group).alias("g"), F.struct(F.col("slot").cast("int").alias("slot"), F.col("attempt").cast("int").alias("attempt"), own.alias("seed"), "text", "key").alias("x"))
    start = F.struct(F.lit(-1).alias("done"), F.array().cast("array<string>").alias("seen"), *(F.lit(0).cast("long").alias(c) for c in ("attempts", "duplicates", "invalid")), F.array().cast(_ACCEPTED).alias("accepted"))

    def step(a: Column, x: Column) -> Column:
        tried, valid = x["slot"] != a["done"], x["text"].isNotNull()
        again = valid & F.array_contains(a["seen"], x["key"])
        takes = tried & valid & (F.lit(preserve) | ~again)
        add = lambda name, c: (a[name] + (tried & c).cast("long")).alias(name)
        one = F.struct(x["slot"].alias("slot"), x["attempt"].alias("attempt"), x["seed"].alias("seed"), x["text"].alias("text"), again.alias("duplicate"))
        return F.struct(
            F.when(takes, x["slot"]).otherwise(a["done"]).alias("done"), F.when(takes, F.array_append(a["seen"], x["key"])).otherwise(a["seen"]).alias("seen"),
            add("attempts", F.lit(True)), add("duplicates", again), add("invalid", ~valid), F.when(takes, F.array_append(a["accepted"], one).cast(_ACCEPTED)).otherwise(a["accepted"]).alias("accepted"),
        )

    played = rows.groupBy("g").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("g", F.aggregate("xs", start, step).alias("s"))
    return played.select(F.col("g").alias(group), "s.accepted", "s.attempts", "s.duplicates", "s.invalid", (F.size("s.accepted") < slots).alias("exhausted"))


#: The counters of a group and of the whole arm.
COUNTERS = ("attempts", "duplicates", "invalid")


#: Accepted rows of one task, which its sorts hold.
TASK_ROWS = 500_000


def arm_faults(cohort: DataFrame, accepted: DataFrame, groups: DataFrame, summary: DataFrame, controls: DataFrame, most: int, seed: int, preserve: bool = False, same: Sequence[str] = ()) -> DataFrame:
    """What is wrong with an arm: (group, position, fault), position null for faults of a group, both null for those of the arm.

    cohort(group, place from 0, same...): the frozen groups in order. accepted(group, position, evaluation_id, slot, control, attempt,
    seed, key, duplicate, same...): its rows, which must repeat the cohort's `same` columns. groups(group, place, attempts, duplicates,
    invalid, exhausted): its journal. summary(accepted, attempts, duplicates, invalid, exhausted): one row. controls(slot, control).
    The state that a row stands in (slots given, keys seen) is recomputed from the rows before it. Null never equals what is asked.
    Rows are written once. Those with their state go without ids to tasks whose number follows theirs; ids are looked up apart, where null
    ones, which are never repeated, aren't sent."""
    accepted = written(accepted, "accepted")
    tasks = max(int(accepted.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-accepted.count() // TASK_ROWS))
    slots = F.broadcast(controls.agg(F.count(F.lit(1)).cast("int").alias("__slots")))
    order = Window.partitionBy("group").orderBy("position")
    state = {
        "__seen": F.row_number().over(Window.partitionBy("group", "key").orderBy("position")) > 1,
        "__next": F.coalesce(F.lag("slot").over(order) + 1, F.lit(0)),
    }
    frozen = cohort.select(F.col("group").alias("__g"), F.col("place").alias("__place"), *(F.col(c).alias(f"__{c}") for c in same))
    asked = controls.select(F.col("slot").alias("__slot"), F.col("control").alias("__control"))
    differs = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    given = accepted.select(
        "group", "position", "slot", "control", "key", "duplicate", *same, F.try_subtract(F.col("seed"), F.lit(seed) + F.col("slot") * most + F.col("attempt") - 1).alias("__offset"),
        differs(F.col("evaluation_id"), F.concat(F.col("group").cast("string"), F.lit("::candidate::"), F.col("position").cast("string"))).alias("__other_id"), (~F.coalesce(F.col("attempt").between(1, most), F.lit(False))).alias("__attempt"),
    )
    rows = given.repartition(tasks, "group").withColumns(state).join(frozen, F.col("group") == F.col("__g"), "left").join(F.broadcast(asked), F.col("slot") == F.col("__slot"), "left").join(slots)
    known = F.col("__g").isNotNull()
    blank = F.coalesce(F.col("key"), F.lit("")) == ""
    tests = {
        "unknown_group": ~known,
        "evaluation_id": F.col("__other_id"),
        "empty_output": blank,
        "repeated_output": F.col("__seen") & ~blank & F.lit(not preserve),
        "duplicate_flag": differs(F.coalesce("duplicate", F.lit(False)), F.col("__seen")),
        "slot_order": ~F.coalesce((F.col("slot") >= F.col("__next")) & (F.col("slot") < F.col("__slots")), F.lit(False)),
        "control": differs(F.col("control"), F.col("__control")),
        "attempt": F.col("__attempt"),
        "seed": known & differs(F.col("__offset"), F.col("__place") * SEED_STEP),
        **{f"other_{c}": known & ~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in same},
    }
    of_rows = rows.select("group", F.col("position").cast("long").alias("position"), F.explode(labels(tests)).alias("fault"))
    named = accepted.where("evaluation_id is not null").select("evaluation_id", "group", F.col("position").cast("long").alias("position"))
    repeated = named.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("__times")).where("__times > 1").select("evaluation_id")
    of_ids = named.join(repeated.hint("merge"), "evaluation_id").select("group", "position", F.lit("repeated_evaluation_id").alias("fault"))
    both = frozen.select("__g", "__place").join(groups.select(F.col("group").alias("__h"), F.col("place").alias("__at")), F.col("__g") == F.col("__h"), "full")
    of_group = {"missing_group": F.col("__h").isNull(), "extra_group": F.col("__g").isNull(), "group_order": F.col("__place") != F.col("__at")}
    of_groups = both.select(F.coalesce("__g", "__h").alias("group"), F.lit(None).cast("long").alias("position"), F.explode(labels(of_group)).alias("fault"))
    totals = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"__{c}") for c in COUNTERS), F.count_if(F.col("exhausted")).alias("__exhausted")).join(accepted.agg(F.count(F.lit(1)).alias("__accepted")))
    counted = {f"summary_{c}": differs(F.col(c), F.col(f"__{c}")) for c in ("accepted", *COUNTERS, "exhausted")}
    of_arm = summary.join(totals).select(F.lit(None).cast(accepted.schema["group"].dataType).alias("group"), F.lit(None).cast("long").alias("position"), F.explode(labels(counted)).alias("fault"))
    return of_rows.unionByName(of_ids).unionByName(of_groups).unionByName(of_arm)


def arm_report(accepted: DataFrame, groups: DataFrame, target: int) -> DataFrame:
    """One row (groups, complete, incomplete, accepted, attempts, duplicates, invalid, exhausted): a group is complete that has `target`
    rows and isn't exhausted."""
    counted = accepted.groupBy("group").agg(F.count(F.lit(1)).alias("__n"))
    each = groups.join(counted, "group", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    full = (F.col("__n") == target) & ~F.coalesce("exhausted", F.lit(False))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.count_if(full).alias("complete"), F.count_if(~full).alias("incomplete"), F.coalesce(F.sum("__n"), F.lit(0)).alias("accepted"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS), F.count_if("exhausted").alias("exhausted"))
