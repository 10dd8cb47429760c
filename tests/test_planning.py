"""Covering samples, balanced splits and batches, lanes, query sets and arm audits against plain loops."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import assignment, coverage, generation, pairs


def plain_cover(rows, axes, size, seed, pool=None, least=1):
    """rows: dicts with id. One row after another with the greatest sum of 1 / (1 + count), ties by digest, then id."""
    counts, common = Counter(), Counter(r[pool] for r in rows) if pool else {}
    value = lambda r, a: "pooled" if a == pool and common[r[a]] < least else r[a]
    left, out = list(rows), []
    for _ in range(size):
        best = min(left, key=lambda r: (-sum(1.0 / (1 + counts[a, value(r, a)]) for a in axes), hashlib.sha256(f"{seed}:{r['id']}".encode()).hexdigest(), str(r["id"])))
        left.remove(best)
        out.append(best["id"])
        for a in axes:
            counts[a, value(best, a)] += 1
    return out


@pytest.mark.parametrize("seed,size", [(1, 40), (2, 400), (3, 1000)])
def test_covered_sample_equals_plain_greedy(spark, seed, size):
    rng = random.Random(seed)
    rows = [{"id": k, "a": rng.choice(["x", "y", "z", None]), "b": rng.choice("pqrstuv"), "c": min(9, int(rng.expovariate(0.5)))} for k in range(1000)]
    df = spark.createDataFrame([(r["id"], r["a"], r["b"], r["c"], 7) for r in rows], "id long, a string, b string, c int, position2 int")
    got = coverage.covered_sample(df, "id", ["a", "b", "c"], size, 42, pool="c", least=30).orderBy("position")
    assert got.columns == [*df.columns, "position"]
    assert [r["id"] for r in got.collect()] == plain_cover(rows, ["a", "b", "c"], size, 42, "c", 30)


def test_covered_sample_refuses_more_than_there_is(spark):
    df = spark.range(3).withColumn("a", F.lit("x"))
    assert coverage.covered_sample(df, "id", ["a"], 3, 1).count() == 3 and coverage.covered_sample(df.limit(0), "id", ["a"], 0, 1).count() == 0
    with pytest.raises(ValueError, match="4 rows are asked for"):
        coverage.covered_sample(df, "id", ["a"], 4, 1)


SHARES = {"train": 0.8, "dev": 0.1, "test": 0.1}


def plain_splits(rows, shares, seed):
    """rows (component, domain) -> {component: split}, the sequential rule."""
    total, of = len(rows), Counter(d for _, d in rows)
    sizes, domains = Counter(c for c, _ in rows), defaultdict(Counter)
    for c, d in rows:
        domains[c][d] += 1
    loads, held, out = Counter(), Counter(), {}
    for c in sorted(sizes, key=lambda c: (-sizes[c], c)):
        def pressure(s):
            whole = (loads[s] + sizes[c]) / max(total * shares[s], 1e-12)
            return whole + sum((held[d, s] + n) / max(of[d] * shares[s], 1e-12) for d, n in sorted(domains[c].items(), key=lambda x: (x[0] is not None, x[0])))
        tie = lambda s: int.from_bytes(hashlib.blake2b(f"{seed}:{c}:{s}".encode(), digest_size=8).digest(), "big")
        out[c] = min(shares, key=lambda s: (pressure(s), tie(s), s))
        loads[out[c]] += sizes[c]
        for d, n in domains[c].items():
            held[d, out[c]] += n
    return out


@pytest.mark.parametrize("seed", range(3))
def test_balanced_splits_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{min(int(rng.paretovariate(0.7)), 400):03}", rng.choice(["news", "wiki", "forum", None])) for _ in range(1500)]
    got = assignment.balanced_splits(spark.createDataFrame(rows, "component string, domain string"), "component", "domain", SHARES, 42)
    assert {r["component"]: r["split"] for r in got.collect()} == plain_splits(rows, SHARES, 42)


def test_balanced_splits_of_many_components_keep_the_shares(spark):
    """With few steps, like components are handed out together: all are placed once, and shares hold for each domain."""
    rows = spark.range(30_000).select((F.col("id") % 12_000).cast("string").alias("c"), F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("d"))
    got = assignment.balanced_splits(rows, "c", "d", SHARES, steps=50)
    assert got.count() == 12_000 == got.select("c").distinct().count()
    held = rows.join(got.select("c", "split"), "c").groupBy("d", "split").count().collect()
    for r in held:
        assert abs(r["count"] / 6000 - SHARES[r["split"]]) < 0.02


def test_driver_sees_few_classes_of_many_kinds(spark, monkeypatch):
    """Components that all differ are bundled beyond MOST * steps classes; the largest ones are steps of their own."""
    rng, seen, plain = random.Random(1), [], assignment.Balance.__call__

    def counted(self, classes):
        return plain(self, (seen.append(r) or r for r in classes))

    monkeypatch.setattr(assignment.Balance, "__call__", counted)
    sizes = {f"c{k:04}": 400 if k < 3 else rng.randrange(1, 30) for k in range(1500)}
    rows = [(c, rng.choice("abcd")) for c, n in sizes.items() for _ in range(n)]
    got = assignment.balanced_splits(spark.createDataFrame(rows, "c string, d string"), "c", "d", SHARES, steps=40).collect()
    assert sorted((r["c"], r["size"]) for r in got) == sorted(sizes.items())
    assert len(seen) <= assignment.MOST * 40 and sum(r["size"] for r in seen) == len(rows) == sum(d["n"] for r in seen for d in r["domains"])
    assert [(r["leader"], r["size"]) for r in seen[:3]] == [("c0000", 400), ("c0001", 400), ("c0002", 400)]
    of, held = {r["c"]: r["split"] for r in got}, Counter()
    for c, d in rows:
        held[d, of[c]] += 1
    for d in "abcd":
        assert all(abs(held[d, s] / sum(held[d, t] for t in SHARES) - p) < 0.03 for s, p in SHARES.items())


def test_balanced_splits_are_the_sequential_rule_at_any_size(spark):
    """As many components as were once handed out together in blocks, where like ones stand apart, and parts that aren't full."""
    rng = random.Random(5)
    rows = [(f"c{k:06}", rng.choice("abcde")) for k in range(110_000) for _ in range(1 + (k % 997 == 0))]
    got = assignment.balanced_splits(spark.createDataFrame(rows, "component string, domain string"), "component", "domain", SHARES, 42)
    assert {r["component"]: r["split"] for r in got.collect()} == plain_splits(rows, SHARES, 42)


@pytest.mark.parametrize("part", [1, 7, 40, 4096])
def test_parts_do_not_change_choices(spark, monkeypatch, part):
    monkeypatch.setattr(assignment, "PART", part)
    rng = random.Random(part)
    rows = [(f"c{k:03}", rng.choice(["x", "y", None])) for k in range(80) for _ in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "component string, domain string")
    got = assignment.balanced_splits(df, "component", "domain", SHARES, 42)
    assert {r["component"]: r["split"] for r in got.collect()} == plain_splits(rows, SHARES, 42)
    assert assignment.balanced_splits(df.limit(0), "component", "domain", SHARES, 42).collect() == []


def test_balanced_batches_are_list_scheduling_at_any_size(spark):
    n, workers = 110_000, ("a", "b")
    loads, batches, want = dict.fromkeys(workers, 0), dict.fromkeys(workers, 0), {}
    for k in range(n):
        cost = {"a": 10 + 7 * (k % 2), "b": 15 + k % 2}
        w = min(workers, key=lambda w: (loads[w] + cost[w], batches[w], w))
        want[k], loads[w], batches[w] = w, loads[w] + cost[w], batches[w] + 1
    got = assignment.balanced_batches(spark.range(n), "id", {"a": 10 + 7 * (F.col("id") % 2), "b": 15 + F.col("id") % 2})
    assert {r["id"]: r["worker"] for r in got.collect()} == want


def test_domain_shares_hold_on_a_given_table(spark, sf):
    from millrace.plans import everything

    orders = spark.read.parquet(f"{sf}/orders.parquet").where("o_custkey is not null")
    rows = orders.join(everything.queries()["domain_splits"](spark, sf).select("o_custkey", "split"), "o_custkey")
    assert rows.count() == orders.count()
    for r in rows.groupBy("o_orderpriority").agg(F.avg((F.col("split") == "train").cast("double")).alias("train")).collect():
        assert abs(r["train"] - 0.9) < 0.06


def test_balanced_batches_equal_list_scheduling(spark):
    rng = random.Random(4)
    batches = [(k, rng.randrange(1, 50)) for k in range(700)]
    loads, n, want = dict.fromkeys("ab", 0), dict.fromkeys("ab", 0), {}
    for k, size in batches:
        cost = {"a": size + 5, "b": 2 * size}
        w = min("ab", key=lambda w: (loads[w] + cost[w], n[w], w))
        want[k], loads[w], n[w] = (w, cost[w]), loads[w] + cost[w], n[w] + 1
    df = spark.createDataFrame(batches, "k long, size long")
    costs = {"a": F.col("size") + 5, "b": 2 * F.col("size")}
    assert {r["k"]: (r["worker"], r["cost"]) for r in assignment.balanced_batches(df, "k", costs).collect()} == want
    few = assignment.balanced_batches(df, "k", costs, steps=20)
    assert few.count() == 700
    by = {r["worker"]: r["c"] for r in few.groupBy("worker").agg(F.sum("cost").alias("c")).collect()}
    assert max(by.values()) < 1.3 * max(loads.values())
    with pytest.raises(ValueError, match="beyond its limits"):
        assignment.balanced_batches(df, "k", costs, {"a": (10, 10**9)})


def test_lanes_walk_whole_passages(spark):
    items = [(f"p{k % 23}", k) for k in range(400)] + [(None, 1000), (None, 1001)]
    df = spark.createDataFrame(items, "passage string, item long")
    laned = assignment.lanes(df, "passage", "item", 4)
    order = sorted({p for p, _ in items}, key=lambda p: hashlib.sha256(("\0" if p is None else p).encode()).hexdigest())
    want = {p: (k, k % 4) for k, p in enumerate(order)}
    rows = laned.collect()
    assert len(rows) == len(items) and all((r["passage_rank"], r["lane"]) == want[r["passage"]] for r in rows)
    per = Counter(lane for _, lane in want.values())
    assert max(per.values()) - min(per.values()) <= 1
    parts = assignment.walked(laned, "item", 4).rdd.glom().collect()
    assert len(parts) == 4
    for part in parts:
        assert len({r["lane"] for r in part}) == 1 and [(r["passage_rank"], r["item"]) for r in part] == sorted((r["passage_rank"], r["item"]) for r in part)


def test_request_choices_equal_a_plain_loop(spark):
    passages = [("p1", ["fact", "definition"], 0), ("p2", ["fact"], 1), ("p3", ["procedure", "fact", "definition"], 9)]
    forms, modes, temps, seeds = ("question", "keywords"), ("none", "bucket", "sentence"), (0.2, 0.75), (1, 2, 3)
    want = {}
    for i, may, n in passages:
        focus = ["none:None", "bucket:beginning", "bucket:middle", "bucket:end", *(f"sentence:{k}" for k in (sorted({0, n // 2, n - 1}) if n else []))]
        left = list(itertools.product(forms, may, focus, ["0.2", "0.75"], ["1", "2", "3"]))
        seen, out = [set() for _ in range(5)], []
        for _ in range(10):
            best = min(left, key=lambda c: (-sum(v not in s for v, s in zip(c, seen)), coverage.choice_tie(c, i, 7)))
            left.remove(best)
            out.append(best)
            for s, v in zip(seen, best):
                s.add(v)
        want[i] = out
    df = spark.createDataFrame(passages, "id string, may array<string>, n int")
    got = coverage.request_choices(df, "id", "may", "n", forms, modes, temps, seeds, 10, 7).orderBy("id", "position").collect()
    for i in want:
        assert [tuple(r)[2:] for r in got if r["id"] == i] == want[i]
    with pytest.raises(Exception, match="fewer than 500 eligible"):
        coverage.request_choices(df, "id", "may", "n", forms, modes, temps, seeds, 500, 7).collect()


def test_ties_of_all_choices_at_once():
    """The digests of single choices, odd characters too, and in far less time, as all are made for each passage."""
    import time

    values = [("question", 'a "b" \\ é\n'), ("fact", "x"), tuple(f"sentence:{k}" for k in range(40)), ("0.2", "1"), ("11", "12")]
    began = time.process_time()
    want = [coverage.choice_tie(c, 'p "1"', 7) for c in itertools.product(*values)]
    middle = time.process_time()
    got = coverage.choice_ties(values, 'p "1"', 7)
    chosen = coverage.cover_choices(values, 8, got)
    assert time.process_time() - middle < middle - began
    assert [g.hex() for g in got] == want and len(set(chosen)) == 8


def plain_sets(tries, slots, most, seed, preserve):
    """tries {(slot, attempt): (text, key)}"""
    seen, out, attempts, duplicates, invalid = set(), [], 0, 0, 0
    for slot in range(slots):
        for attempt in range(1, most + 1):
            if (slot, attempt) not in tries:
                continue
            text, key = tries[slot, attempt]
            attempts += 1
            if text is None:
                invalid += 1
                continue
            again = key in seen
            duplicates += again
            if again and not preserve:
                continue
            seen.add(key)
            out.append((slot, attempt, seed + slot * most + attempt - 1, text, again))
            break
    return out, attempts, duplicates, invalid, len(out) < slots


@pytest.mark.parametrize("preserve", [False, True])
def test_query_sets_replay_the_loop(spark, preserve):
    rng, rows, want = random.Random(9), [], {}
    for g in range(60):
        tries = {(s, a): (None, None) if rng.random() < 0.2 else ((w := rng.choice("abcde")).upper(), w) for s in range(4) for a in range(1, 4) if rng.random() < 0.95}
        rows += [(g, s, a, *t) for (s, a), t in tries.items()] + [(g, 0, 9, "x", "x"), (g, 7, 1, "x", "x")]
        want[g] = plain_sets(tries, 4, 3, 100 * g, preserve)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, slot int, attempt int, text string, key string")
    got = generation.query_sets(df, "g", 4, 3, F.col("g") * 100, preserve)
    assert {r["g"]: ([tuple(x) for x in r["accepted"]], r["attempts"], r["duplicates"], r["invalid"], r["exhausted"]) for r in got.collect()} == want


def test_arm_faults_find_each_planted_fault(spark):
    """A clean arm has no fault; each change is found as what it is."""
    cohort = [(f"g{k}", k, f"r{k}") for k in range(4)]
    rows = [(g, p, f"{g}::candidate::{p}", p, f"c{p}", 1, 50 + k * 1000 + p * 2, f"{g}{p}", False, ref) for g, k, ref in cohort for p in range(3)]
    groups = [(g, k, 3, 0, 0, False) for g, k, _ in cohort]

    def faults(rows=rows, groups=groups, summary=(12, 12, 0, 0, 0)):
        frame = spark.createDataFrame
        out = generation.arm_faults(
            frame(cohort, "group string, place long, ref string"), frame(rows, "group string, position int, evaluation_id string, slot int, control string, attempt int, seed long, key string, duplicate boolean, ref string"),
            frame(groups, "group string, place long, attempts long, duplicates long, invalid long, exhausted boolean"), frame([summary], "accepted long, attempts long, duplicates long, invalid long, exhausted long"),
            frame([(p, f"c{p}") for p in range(3)], "slot int, control string"), 2, 50, same=["ref"],
        )
        return sorted((r["group"] or "", r["position"] if r["position"] is not None else -1, r["fault"]) for r in out.collect())

    def changed(at, **new):
        names = ["group", "position", "evaluation_id", "slot", "control", "attempt", "seed", "key", "duplicate", "ref"]
        return [tuple(new.get(n, v) for n, v in zip(names, r)) if k == at else r for k, r in enumerate(rows)]

    assert faults() == []
    assert faults(changed(1, evaluation_id=None)) == [("g0", 1, "evaluation_id")]
    assert faults(changed(1, evaluation_id="g0::candidate::0")) == [("g0", 0, "repeated_evaluation_id"), ("g0", 1, "evaluation_id"), ("g0", 1, "repeated_evaluation_id")]
    assert faults(changed(2, seed=1)) == [("g0", 2, "seed")] and faults(changed(2, attempt=3)) == [("g0", 2, "attempt"), ("g0", 2, "seed")]
    assert faults(changed(4, key="g10")) == [("g1", 1, "duplicate_flag"), ("g1", 1, "repeated_output")]
    assert faults(changed(4, duplicate=True)) == [("g1", 1, "duplicate_flag")] and faults(changed(4, key="")) == [("g1", 1, "empty_output")]
    assert faults(changed(4, slot=0, seed=1050)) == [("g1", 1, "control"), ("g1", 1, "slot_order")]
    assert faults(changed(4, control="c0")) == [("g1", 1, "control")] and faults(changed(4, ref=None)) == [("g1", 1, "other_ref")]
    assert faults(groups=groups[:3], summary=(12, 9, 0, 0, 0)) == [("g3", -1, "missing_group")]
    assert faults(groups=[*groups, ("new", 4, 0, 0, 0, True)]) == [("", -1, "summary_exhausted"), ("new", -1, "extra_group")]
    assert faults(groups=[groups[1][:1] + (0,) + groups[1][2:], *groups[2:], groups[0]]) == [("g1", -1, "group_order")]
    assert faults(summary=(11, 12, 1, 2, 0)) == [("", -1, "summary_accepted"), ("", -1, "summary_duplicates"), ("", -1, "summary_invalid")]


def test_defect_pairs_need_certified_chosen_ones(spark):
    schema = "group long, eligible boolean, candidate long, position long, query string, prompt string, verdict string, clean boolean, format_ok boolean, round_trip double, overlap double, margin double, defects array<string>"
    row = lambda g, c, q, verdict, **k: (g, k.get("eligible", True), c, c, q, k.get("prompt", "p"), verdict, True, True, k.get("hit", 1.0), k.get("overlap", 0.04), 1.0, None)
    rows = [
        row(1, 10, "one two", "uncertain"), row(1, 11, "three four", "no"),  # uncertain is never chosen
        row(2, 20, "one two", "yes"), row(2, 21, "one two", "no"),  # near duplicates
        row(3, 30, "one two three", "yes"), row(3, 31, "four five", "yes"), row(3, 32, "one two nine", "no", hit=0.0),
        row(4, 40, "one", "yes", eligible=False), row(5, 50, "a b", "yes", overlap=0.01), row(5, 51, "c d", "yes", overlap=0.2),
    ]
    out = {r["group"]: r for r in pairs.defect_pairs(spark.createDataFrame(rows, schema), "salt").collect()}
    assert out[1]["axis"] is None and "no_admissible_chosen" in out[1]["failure_reasons"] and len(out[1]["attempts"]) == 2
    assert "near_duplicate_query_pair" in out[2]["failure_reasons"]
    assert (out[3]["axis"], out[3]["chosen"], out[3]["rejected"]) == ("A", 31, 32)  # the one least like the others
    assert out[4]["attempts"] == [] and out[4]["failure_reasons"] == ["group_not_gate_eligible"]
    assert (out[5]["axis"], out[5]["chosen"], out[5]["rejected"]) == ("B", 50, 51)
    for bad in ([row(1, 1, "x", None)], [row(1, 1, "x", "yes"), row(1, 2, "y", "no", prompt="q")]):
        with pytest.raises(Exception, match="no verdict|more than one prompt"):
            pairs.defect_pairs(spark.createDataFrame(bad, schema), "salt").collect()


def test_defect_pairs_are_made_in_one_pass_over_a_group(spark):
    """Rows of a group are collected once, prompts aren't told apart by a further aggregation, and few projections carry the rows on."""
    schema = "group long, eligible boolean, candidate long, position long, query string, prompt string, verdict string, clean boolean, format_ok boolean, round_trip double, overlap double, margin double, defects array<string>"
    rows = [(1, True, 10, 1, "one two", "p", "yes", True, True, 1.0, 0.0, 1.0, None), (1, True, 11, 2, "three", "p", "no", True, True, 1.0, 0.0, 0.5, ["d"]), (2, True, 20, 1, "x", None, "yes", True, True, 1.0, 0.0, None, None)]
    out = pairs.defect_pairs(spark.createDataFrame(rows, schema), "salt")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "array_union" not in plan and plan.count("Project [") <= 8
    got = {r["group"]: r for r in out.collect()}
    assert (got[1]["chosen"], got[1]["rejected"], got[1]["likeness"], got[1]["margin_delta"], got[1]["rejected_defects"]) == (10, 11, 0.0, 0.5, ["d"])
    assert (got[2]["chosen"], got[2]["failure_reasons"], len(got[2]["attempts"])) == (None, ["no_axis_defect_rejected"], 2)


def test_likeness_of_sets_is_that_of_arrays(spark):
    from millrace.functions import text as T

    sets = [[], ["a"], ["b", "a"], [f"w{k}" for k in range(40)], [f"w{k}" for k in range(30, 60)]]
    df = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    assert df.where(T.jaccard(a, b, 1.0) != T.set_jaccard(a, b, 1.0)).count() == 0


def test_arm_faults_read_rows_once_and_send_no_null_ids(spark):
    """Accepted rows are made once; rows without an id, which may be many, aren't brought together to look their ids up."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(x):
        seen.add(1)
        return x

    frame = spark.createDataFrame
    rows = [("g", p, "g::candidate::0" if p < 2 else None, p, f"c{p}", 1, 50 + p * 2, f"k{p}", False) for p in range(3)]
    accepted = frame(rows, "group string, position int, evaluation_id string, slot int, control string, attempt int, seed long, key string, duplicate boolean").repartition(2).withColumn("key", noted("key"))
    out = generation.arm_faults(
        frame([("g", 0)], "group string, place long"), accepted, frame([("g", 0, 3, 0, 0, False)], "group string, place long, attempts long, duplicates long, invalid long, exhausted boolean"),
        frame([(3, 3, 0, 0, 0)], "accepted long, attempts long, duplicates long, invalid long, exhausted long"), frame([(p, f"c{p}") for p in range(3)], "slot int, control string"), 2, 50,
    )
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x and "evaluation_id" in x]
    assert len(joins) == 1 and "Join Inner" in joins[0]
    found = sorted((r["position"], r["fault"]) for r in out.collect())
    assert found == [(0, "repeated_evaluation_id"), (1, "evaluation_id"), (1, "repeated_evaluation_id"), (2, "evaluation_id")]
    assert seen.value == 3


def test_crossing_negatives_read_records_once(spark):
    from millrace.operators import splits

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def once(i):
        seen.add(1)
        return i

    doc = "array<struct<doc_id:string,text:string>>"
    d = lambda *ids: [(i, i) for i in ids]
    rows = [(1, d("a"), d("b", "c", "z")), (2, d("b"), d("a", "z")), (3, d("c"), None), (4, None, []), (5, d("a", "c"), [("c", "c"), None, ("b", "b"), ("c", "c")])]
    records = spark.createDataFrame(rows, f"example_id long, positives {doc}, hard_negatives {doc}").withColumn("example_id", once.asNondeterministic()("example_id"))
    homes = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "train"), (4, "dev"), (5, "train")], "example_id long, split string")
    got = {r["example_id"]: (r["hard_negatives"] and [x and x["doc_id"] for x in r["hard_negatives"]], r["removed"], r["below"]) for r in splits.drop_crossing_negatives(records, homes, 2).collect()}
    assert got == {1: (["c", "z"], 1, False), 2: (["z"], 1, True), 3: (None, 0, None), 4: ([], 0, True), 5: (["c", None, "c"], 1, False)}
    assert seen.value == 5


@pytest.mark.parametrize("swapped", [False, True])
def test_shingles_of_the_larger_side_do_not_move(spark, monkeypatch, swapped):
    from millrace.operators import dedup

    monkeypatch.setattr(dedup, "FEW", 6)
    many = spark.createDataFrame([(k, [f"s{j}" for j in range(k % 5)]) for k in range(40)], "id long, shingles array<string>")
    few = spark.createDataFrame([(1, ["s0", "s1"]), (2, ["s3", "x"])], "ref long, shingles array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dedup.shingle_overlap(few, many, "ref", "id", 0.5) if swapped else dedup.shingle_overlap(many, few, "id", "ref", 0.5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r["id"], r["ref"], round(r["similarity"], 6)) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {(k, 1, round(2 / (k % 5), 6) if k % 5 > 1 else 0.5) for k in range(40) if k % 5}
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_simhash_takes_arrow_batches(spark):
    """A batch's texts are not all Python strings at once; null is the empty text."""
    from pyspark.util import PythonEvalType

    from millrace.operators import dedup

    assert dedup.simhash.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    df = spark.createDataFrame([(k, t) for k, t in enumerate((None, "", "a b c d", "é \U0001f600"))], "id long, text string")
    assert {r["id"]: r["h"] for r in df.select("id", dedup.simhash("text").alias("h")).collect()} == {k: dedup.simhash64(t) for k, t in enumerate(("", "", "a b c d", "é \U0001f600"))}
