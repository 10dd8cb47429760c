"""What goes to training: preference rows and continued rows from candidate sets, evidence bundles, and the package of three tables that
must hold the same items in the same order. Faults come as rows; what is made of rows with faults is up to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pairs import labels

#: What a set and each of its candidates must agree in.
SET_IDENTITY = ("split", "passage_id")
from .tables import ranked


def _each_rejected(sets: DataFrame) -> DataFrame:
    return sets.select("*", F.posexplode(F.arrays_zip(F.col("rejected_ids").alias("id"), F.col("margins").alias("margin"))).alias("place", "r")).select("*", F.col("r.id").alias("rejected_id"), F.col("r.margin").alias("score_margin")).drop("r", "rejected_ids", "margins")


def _with_candidates(sets: DataFrame, candidates: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    side = lambda s: candidates.select(F.col("candidate_id").alias(f"{s}_id"), F.struct(*(c for c in candidates.columns if c != "candidate_id")).alias(f"{s}_row"))
    return _each_rejected(sets).join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")


def export_faults(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """candidates(candidate_id, split, passage_id, query, ...), sets(set_id, split, passage_id, prompt, chosen_id, rejected_ids, margins)
    -> (set_id, rejected_id, fault): missing_chosen, missing_rejected, chosen_drift, rejected_drift (another split or passage than the set),
    identical_pair (equal but for case), margins_length (not one margin a rejected one)."""
    rows = _with_candidates(sets, candidates)
    same = lambda s: F.coalesce(sum((F.col(f"{s}_row.{c}").eqNullSafe(F.col(c)).cast("int") for c in SET_IDENTITY), F.lit(0)) == len(SET_IDENTITY), F.lit(False))
    there = lambda s: F.col(f"{s}_row").isNotNull()
    tests = {
        "missing_chosen": ~there("chosen"), "missing_rejected": ~there("rejected"), "chosen_drift": there("chosen") & ~same("chosen"), "rejected_drift": there("rejected") & ~same("rejected"),
        "identical_pair": T.folded(F.col("chosen_row.query")) == T.folded(F.col("rejected_row.query")),
    }
    lengths = sets.where(F.size("rejected_ids") != F.size("margins")).select("set_id", F.lit(None).cast(candidates.schema["candidate_id"].dataType).alias("rejected_id"), F.lit("margins_length").alias("fault"))
    return rows.select("set_id", "rejected_id", F.explode(labels(tests)).alias("fault")).unionByName(lengths)


def preference_rows(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """One row a rejected candidate: (preference_id, split, passage_id, prompt, place, chosen_id, rejected_id, chosen, rejected, score_margin,
    chosen_row, rejected_row); place is that in the set. The rows hold all other columns of the candidates."""
    rows = _with_candidates(sets, candidates)
    key = F.concat_ws("::", F.col("set_id").cast("string"), F.col("rejected_id").cast("string"))
    return rows.select(key.alias("preference_id"), "split", "passage_id", "prompt", "place", "chosen_id", "rejected_id", F.col("chosen_row.query").alias("chosen"), F.col("rejected_row.query").alias("rejected"), "score_margin", "chosen_row", "rejected_row")


def continued_rows(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The chosen side alone, once for each split and candidate: (split, candidate_id, passage_id, prompt, completion)."""
    chosen = sets.join(candidates.select(F.col("candidate_id").alias("chosen_id"), F.col("query").alias("completion")), "chosen_id")
    return chosen.groupBy("split", F.col("chosen_id").alias("candidate_id")).agg(*(F.max_by(c, F.struct("set_id")).alias(c) for c in ("passage_id", "prompt", "completion")))


def one_sided(preferences: DataFrame) -> DataFrame:
    """(query, chosen, rejected): queries, case folded, that stand on one side only, and how often."""
    sides = preferences.select(F.explode(F.array(*(F.struct(T.folded(F.col(s)).alias("query"), F.lit(s).alias("side")) for s in ("chosen", "rejected")))).alias("x")).select("x.*")
    return sides.groupBy("query").agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("chosen", "rejected"))).where("chosen = 0 or rejected = 0")


#: What a continued row must repeat of its preference: its column there, and here.
CONTROL_IDENTITY = {"prompt": "prompt", "chosen": "completion", "chosen_id": "candidate_id", "passage_id": "passage_id", "cluster_id": "cluster_id", "split": "split", "provenance": "provenance"}


def _numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """(preference_id, name_rank, n, name: the rest as a struct): the place of each row in its table's order, and how often its id occurs."""
    found = ranked(rows.select("*", F.monotonically_increasing_id().alias("__tie")), *order, "__tie")
    held = found.select("preference_id", F.col("rank").alias(f"{name}_rank"), F.struct(*(c for c in rows.columns if c != "preference_id")).alias(name))
    counts = rows.groupBy("preference_id").agg(F.count(F.lit(1)).alias(f"{name}_n"))
    return held.join(counts, "preference_id")


def handoff_faults(preferences: DataFrame, controls: DataFrame, weights: DataFrame, policy: str, splits: Sequence[str] = ("train", "dev")) -> DataFrame:
    """preferences(preference_id, place, split, prompt, chosen, chosen_id, passage_id, cluster_id, provenance), controls(the same ids with
    place, CONTROL_IDENTITY's other columns), weights(preference_id, place, split, provenance, weight_policy, sample_weight), each in the
    order of split, as `splits` has them, then place -> (preference_id, fault).

    Faults of a row: wrong_split, duplicate_preference, duplicate_control, duplicate_weight, missing_control, orphan_control,
    missing_weight, orphan_weight, control_order, weight_order (its place among the rows isn't that of its preference), control_<column>
    (drift from the preference), weight_split, weight_provenance, weight_policy, bad_weight (null, negative or not finite), provenance
    (another than most preferences'). Of passages and clusters in two splits: passage_leak, cluster_leak with the key as preference_id.

    Orders are compared by the places that a range shuffle numbers, so that no task holds a table."""
    named = lambda df: df.withColumn("__split", F.array_position(F.array(*map(F.lit, splits)), F.col("split"))) if "split" in df.columns else df
    sides = {n: _numbered(named(df), ("__split", "place"), n) for n, df in (("p", preferences), ("c", controls), ("w", weights))}
    both = sides["p"].join(sides["c"], "preference_id", "full").join(sides["w"], "preference_id", "full")
    usual = preferences.groupBy("provenance").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "provenance").limit(1).collect()
    first = usual[0]["provenance"] if usual else None
    has = {n: F.col(n).isNotNull() for n in "pcw"}
    drift = lambda n, mine, theirs: has["p"] & has[n] & ~F.col(f"{n}.{theirs}").eqNullSafe(F.col(f"p.{mine}"))
    value = F.col("w.sample_weight").cast("double")
    tests = {
        "wrong_split": has["p"] & ~F.coalesce(F.col("p.split").isin(*splits), F.lit(False)), "provenance": has["p"] & ~F.col("p.provenance").eqNullSafe(F.lit(first)),
        "missing_control": has["p"] & ~has["c"], "orphan_control": ~has["p"] & has["c"], "missing_weight": has["p"] & ~has["w"], "orphan_weight": ~has["p"] & has["w"],
        "control_order": F.col("p_rank") != F.col("c_rank"), "weight_order": F.col("p_rank") != F.col("w_rank"),
        **{f"duplicate_{long}": F.coalesce(F.col(f"{n}_n") > 1, F.lit(False)) for n, long in (("p", "preference"), ("c", "control"), ("w", "weight"))},
        **{f"control_{theirs}": drift("c", mine, theirs) for mine, theirs in CONTROL_IDENTITY.items()},
        "weight_split": drift("w", "split", "split"), "weight_provenance": drift("w", "provenance", "provenance"), "weight_policy": has["w"] & ~F.col("w.weight_policy").eqNullSafe(F.lit(policy)),
        "bad_weight": has["w"] & ~F.coalesce((value >= 0) & (value < float("inf")), F.lit(False)),
    }
    of_rows = both.select(F.col("preference_id").cast("string").alias("preference_id"), F.explode(labels(tests)).alias("fault")).distinct()
    out = of_rows
    for column, fault in (("passage_id", "passage_leak"), ("cluster_id", "cluster_leak")):
        leaks = preferences.where(F.col(column).isNotNull()).groupBy(column).agg(F.count_distinct("split").alias("n")).where("n > 1")
        out = out.unionByName(leaks.select(F.col(column).cast("string").alias("preference_id"), F.lit(fault).alias("fault")))
    return out


def packaged(controls: DataFrame, weights: DataFrame) -> DataFrame:
    """controls with sample_weight and weight_policy: the weighted continued rows of a package without faults."""
    return controls.join(weights.select("preference_id", "sample_weight", "weight_policy"), "preference_id")


def evidence_faults(candidates: DataFrame, components: dict[str, DataFrame], key: str, identity: Sequence[str], judges: dict[str, tuple[str, str]], tolerance: float = 1e-6) -> DataFrame:
    """candidates(key, identity..., format_valid), components: name -> table(key, identity..., own columns) -> (key, component, fault).

    Faults: missing, orphan, duplicate, identity_<column> (differs from the candidate's). judges: component -> (judge_id, judge_revision),
    which its rows must have (judge_drift); of judges also incorrect_margin (margin isn't positive_score - max_negative_score) and, between
    them, mixed_scales (equal raw_score_scale_id). A component named `format` whose `valid` isn't the candidate's known format_valid has
    format_drift. Each component is joined once, by the key."""
    known = candidates.select(F.col(key), F.lit(True).alias("__known"), F.struct(*identity, *(c for c in ("format_valid",) if c in candidates.columns)).alias("__own"))
    out = None
    for name, df in components.items():
        fields = [c for c in df.columns if c != key]
        rows = df.select(F.col(key), F.struct(*fields).alias("__r"))
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
        both = known.join(rows.join(counts, key), key, "full")
        r, own, there = F.col("__r"), F.col("__own"), F.col("__known").isNotNull() & F.col("__r").isNotNull()
        tests = {"missing": F.col("__known").isNotNull() & r.isNull(), "orphan": F.col("__known").isNull(), "duplicate": F.col("__n") > 1}
        tests |= {f"identity_{c}": there & ~r[c].eqNullSafe(own[c]) for c in identity if c in fields}
        if name in judges:
            who, revision = judges[name]
            tests["judge_drift"] = there & ~(r["judge_id"].eqNullSafe(F.lit(who)) & r["judge_revision"].eqNullSafe(F.lit(revision)))
            tests["incorrect_margin"] = there & ~F.coalesce(F.abs(r["margin"] - (r["positive_score"] - r["max_negative_score"])) <= tolerance, F.lit(False))
        if name == "format" and "format_valid" in candidates.columns:
            tests["format_drift"] = there & own["format_valid"].isNotNull() & ~r["valid"].eqNullSafe(own["format_valid"])
        found = both.select(F.col(key), F.lit(name).alias("component"), F.explode(labels(tests)).alias("fault"))
        out = found if out is None else out.unionByName(found)
    if len(judges) > 1:
        scales = [components[n].select(F.col(key), F.col("raw_score_scale_id").alias(f"__s{k}")) for k, n in enumerate(judges)]
        mixed = scales[0]
        for s in scales[1:]:
            mixed = mixed.join(s, key)
        equal = mixed.where(F.size(F.array_distinct(F.array(*(F.col(f"__s{k}") for k in range(len(judges)))))) < len(judges))
        out = out.unionByName(equal.select(F.col(key), F.lit(" and ".join(judges)).alias("component"), F.lit("mixed_scales").alias("fault")))
    return out.distinct()


def flag_histograms(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """name -> (table, flag) -> (flag, value, n): how often each value of each flag occurs, null as its own."""
    out = None
    for name, (df, flag) in tables.items():
        found = df.groupBy(F.coalesce(flag.cast("string"), F.lit("null")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("flag"), "value", "n")
        out = found if out is None else out.unionByName(found)
    return out
