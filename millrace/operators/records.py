"""Nested records: from parallel lists to documents, inversion to one row a positive, consolidation, and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import ranked_within


def aligned(ids: str, texts: str, scores: str) -> Column:
    """Parallel lists as an array of (doc_id, text, score); lists of unequal length are an error."""
    same = (F.size(ids) == F.size(texts)) & (F.size(ids) == F.size(scores))
    zipped = F.transform(F.arrays_zip(F.col(ids), F.col(texts), F.col(scores)), lambda x: F.struct(x[ids].cast("string").alias("doc_id"), x[texts].alias("text"), x[scores].alias("score")))
    return F.when(same, zipped).otherwise(F.raise_error(F.lit("parallel lists of unequal length")))


def score_filter(docs: Column, least: float, strict: bool = False) -> Column:
    return F.filter(docs, lambda d: d["score"] > least if strict else d["score"] >= least)


def repeated_ids(docs: Column) -> Column:
    """Sorted ids that stand more than once."""
    ids = F.transform(docs, lambda d: d["doc_id"])
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: F.size(F.filter(ids, lambda j: j == i)) > 1)))


def shared_ids(a: Column, b: Column) -> Column:
    """Sorted ids on both sides."""
    of = lambda x: F.transform(x, lambda d: d["doc_id"])
    return F.array_sort(F.array_intersect(of(a), of(b)))


def inverted(records: DataFrame, most: int | None = None) -> DataFrame:
    """records(example_id, query, positives) -> a row for each positive in order of doc_id, with its number, count, lengths and overlap."""
    docs = F.array_sort(F.transform("positives", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["text"].alias("text"))))
    docs = F.slice(docs, 1, most) if most else docs
    rows = records.select("example_id", "query", F.size("positives").cast("long").alias("positive_count"), F.posexplode(docs).alias("positive_index", "d"))
    q, p = T.long_words(F.col("query")), T.long_words(F.col("d.text"))
    return rows.select("example_id", F.col("positive_index").cast("long").alias("positive_index"), "positive_count", F.col("d.doc_id").alias("doc_id"), F.length("query").cast("long").alias("query_chars"), F.length("d.text").cast("long").alias("passage_chars"),
                       F.size(T.words(F.col("query"))).cast("long").alias("query_words"), F.size(T.words(F.col("d.text"))).cast("long").alias("passage_words"), F.when(F.size(q) > 0, T.jaccard(q, p)).otherwise(0.0).alias("lexical_overlap"))


def consolidated(pairs: DataFrame, passage: str, pair_id: str, identity: str) -> DataFrame:
    """(passage, n_pairs, first_pair, drift): pair rows by passage; drift where one passage has several identities."""
    return pairs.groupBy(passage).agg(F.count(F.lit(1)).alias("n_pairs"), F.min(pair_id).alias("first_pair"), (F.count_distinct(identity) > 1).alias("drift"))


def document_union(records: DataFrame) -> DataFrame:
    """(doc_id, text, n_texts) of all positives and hard negatives: unique documents; n_texts over 1 is a conflict."""
    docs = records.select(F.explode(F.concat("positives", "hard_negatives")).alias("d")).select("d.doc_id", "d.text")
    return docs.groupBy("doc_id").agg(F.min("text").alias("text"), F.count_distinct("text").alias("n_texts"))


def ids_digest(rows: DataFrame, id_col: str, buckets: int = 256) -> DataFrame:
    """One row (n, digest): of the set of ids, whatever their order. Digests of ids are sorted in buckets by their first byte,
    a bucket's list is digested, and the buckets' digests are digested: the same for any partitioning; a driver sees one row."""
    each = rows.select(F.sha2(F.col(id_col).cast("string"), 256).alias("h")).withColumn("b", F.substring("h", 1, 2))
    parts = each.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"))
    return parts.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def journal_state(events: DataFrame, item: str, ts: str, order: str, fields: list[str]) -> DataFrame:
    """(item, fields of the last event, n_events): the last response wins, ties by the order column."""
    return events.groupBy(item).agg(*(F.max_by(f, F.struct(ts, order)).alias(f) for f in fields), F.count(F.lit(1)).alias("n_events"))


def rolling_budget(events: DataFrame, key: str, ts: str, order: str, amount: str, seconds: int = 60, slice_seconds: int = 3600) -> DataFrame:
    """events with requests and amount of the last seconds for each key, the row included, and the gap to the one before.

    Time is cut into slices; a row counts in its own and, near its end, as history in the next one, so that a busy key is spread
    over its slices. What came last before a slice is carried over the slices, not the rows. Null times form a slice of their own."""
    width, reach = slice_seconds * 1_000_000, seconds * 1_000_000
    rows = events.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__slice", F.floor(F.col("__at") / width))
    home = F.array(F.struct(F.col("__slice").alias("s"), F.lit(True).alias("own")))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(max(1, -(-seconds // slice_seconds)))), lambda k: F.struct((F.col("__slice") + k).alias("s"), F.lit(False).alias("own")))
    dealt = rows.withColumn("__p", F.explode(F.concat(home, F.filter(ahead, lambda x: x["s"] * width - F.col("__at") <= reach))))
    recent = Window.partitionBy(key, "__p.s").orderBy("__at").rangeBetween(-reach, 0)
    counted = dealt.withColumns({"requests_in_window": F.count(F.lit(1)).over(recent), "amount_in_window": F.sum(amount).over(recent)}).where("__p.own").drop("__p")
    slices = rows.groupBy(key, "__slice").agg(F.max("__at").alias("__last"))
    before = slices.withColumn("__before", F.max("__last").over(Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(key).alias("__k"), F.col("__slice").alias("__s"), "__before")
    joined = counted.join(before, F.col(key).eqNullSafe(F.col("__k")) & F.col("__slice").eqNullSafe(F.col("__s")), "left")
    last = F.coalesce(F.lag("__at").over(Window.partitionBy(key, "__slice").orderBy("__at", order)), F.col("__before"))
    return joined.withColumn("gap_seconds", (F.col("__at") - last) / 1e6).drop("__at", "__slice", "__k", "__s", "__before")


def usable(record_positives: str, record_negatives: str, least_negatives: int = 10) -> Column:
    return (F.size(record_positives) >= 1) & (F.size(record_negatives) >= least_negatives)


def filtered_records(records: DataFrame, least: float = 23.5, strict: bool = False) -> DataFrame:
    """records(positives of doc_id, text, score) with the positives that score enough, `removed_ids` of the others in order, and
    without the records that have none left."""
    keep = score_filter(F.col("positives"), least, strict)
    removed = F.transform(F.filter("positives", lambda d: F.coalesce(~(d["score"] > least if strict else d["score"] >= least), F.lit(True))), lambda d: d["doc_id"])
    return records.withColumns({"positives": keep, "removed_ids": removed}).where(F.size("positives") > 0)


def judged_records(rows: DataFrame, query_id: str, query: str, doc_id: str, text: str, relevant: str) -> DataFrame:
    """One row a judgement -> (example_id, query, positives, hard_negatives): documents that are relevant somewhere are no negatives;
    a question without a positive is left out; two texts of one document in a question are an error."""
    per = rows.groupBy(query_id, doc_id).agg(F.min(query).alias("q"), F.min(text).alias("t"), F.count_distinct(text).alias("n"), F.max(F.col(relevant).cast("boolean")).alias("good"))
    doc = F.struct(F.col(doc_id).cast("string").alias("doc_id"), F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("conflicting texts of "), F.col(doc_id).cast("string")))).otherwise(F.col("t")).alias("text"))
    out = per.groupBy(query_id).agg(F.min("q").alias("query"), F.array_sort(F.collect_list(F.when(F.col("good"), doc))).alias("positives"), F.array_sort(F.collect_list(F.when(~F.col("good"), doc))).alias("hard_negatives"))
    return out.where(F.size("positives") > 0).select(F.col(query_id).cast("string").alias("example_id"), "query", "positives", "hard_negatives")


def scoring_groups(records: DataFrame) -> DataFrame:
    """(example_id, positive_index, query, positive, negatives): a group for each positive with the record's negatives."""
    return records.select("example_id", "query", F.posexplode("positives").alias("positive_index", "positive"), F.col("hard_negatives").alias("negatives")).select("example_id", "positive_index", "query", "positive", "negatives")


def generator_sources(records: DataFrame) -> DataFrame:
    """(example_id, doc_id, passage): each record's first positive by id."""
    first = F.get(F.array_sort(F.transform("positives", lambda d: F.struct(d["doc_id"].alias("doc_id"), d["text"].alias("text")))), 0)
    return records.select("example_id", first.alias("d")).select("example_id", "d.doc_id", F.col("d.text").alias("passage"))


def shard_plan(rows: DataFrame, id_col: str, size: int, seed: str) -> DataFrame:
    """rows(id_col) with `ordinal` in hash order, and `shard`, ordinal // size. Ordinals are counted within ranges of the order,
    which begin where the range before ends."""
    from .statistics import running_sums

    keyed = rows.withColumn("order_key", F.concat_ws(":", F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256), F.col(id_col).cast("string"))).withColumn("__one", F.lit(1).cast("long"))
    numbered = running_sums(keyed, "order_key", "__one", "__upto").withColumn("ordinal", F.col("__upto") - 1)
    return numbered.withColumn("shard", F.floor(F.col("ordinal") / size)).drop("order_key", "__one", "__upto")


def completions(pairs: DataFrame, query: str, passage: str, template: Column, least_words: int = 2) -> DataFrame:
    """(prompt, completion, reason): training rows of pairs; reason says why a row isn't eligible (empty, several_lines, too_short,
    copied) and is null for those that are."""
    line = T.single_line(F.col(query))
    bare = F.coalesce(F.btrim(F.col(query)), F.lit(""))
    reason = F.when(bare == "", "empty").when(line.isNull(), "several_lines").when(F.size(T.words(line)) < least_words, "too_short").when(F.contains(T.squeezed(F.col(passage)), line), "copied")
    return pairs.select("*", template.alias("prompt"), line.alias("completion"), reason.alias("reason"))


def mixed_cohort(natural: DataFrame, synthetic: DataFrame, key: str, seed: str) -> DataFrame:
    """Rows of both by key, from the natural side at even and from the synthetic side at odd places of the hash order, with `kind`.
    Both sides must have the same keys and columns; keys of one side only are left out."""
    shared = shard_plan(natural.select(key).distinct().join(synthetic.select(key).distinct(), key, "left_semi"), key, 1, seed).select(key, (F.col("ordinal") % 2).alias("__odd"))
    return natural.join(shared.where("__odd = 0"), key).withColumn("kind", F.lit("natural")).unionByName(synthetic.join(shared.where("__odd = 1"), key).withColumn("kind", F.lit("synthetic"))).drop("__odd")


#: What a prompt asks for.
ASK = "Napisz jedno polskie zapytanie, na które odpowiada pasaż."


def prompt(passage: Column, controls: dict[str, Column] | None = None, seen: Column | None = None) -> Column:
    """A prompt: what is asked, the controls as `name: value` lines, the queries that are there already, the passage."""
    lines = [F.lit(ASK), *(F.concat(F.lit(f"{k}: "), v) for k, v in (controls or {}).items())]
    if seen is not None:
        lines.append(F.when(F.size(seen) > 0, F.concat(F.lit("- "), F.array_join(seen, "\n- "))))
    return F.concat_ws("\n", *lines, F.concat(F.lit("\nPasaż:\n"), F.btrim(passage)))


def canonical_json(columns: list[str]) -> Column:
    """A row as JSON with its keys in order; null fields show."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(columns: list[str]) -> Column:
    """Of a row's fields, whatever their order."""
    return F.sha2(canonical_json(columns), 256)


def records_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, digest) of the rows as a set with repetitions, whatever their order and partitioning: digests of canonical rows,
    sorted in buckets by their first digits, digested, and again."""
    each = rows.select(fingerprint(columns).alias("h")).withColumn("b", F.substring("h", 1, 3))
    parts = each.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def ordered_digest(rows: DataFrame, order: str, columns: list[str], block: int = 1000) -> DataFrame:
    """One row (n, digest) that depends on the rows' order (a number from 0 without gaps): digests of blocks in order, digested."""
    each = rows.select(F.floor(F.col(order) / block).alias("b"), F.col(order).alias("o"), fingerprint(columns).alias("h"))
    parts = each.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), "\n"), 256).alias("d"))
    tops = parts.groupBy(F.floor(F.col("b") / block).alias("t")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256).alias("d"))
    return tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def drift(requests: DataFrame, candidates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): candidates whose fields differ from their request's, null-safe, with the sorted names; a candidate without a
    request has the field `key`."""
    asked = requests.select(F.col(key).alias("__k"), F.struct(*fields).alias("__q"))
    both = candidates.select(F.col(key), F.struct(*fields).alias("__c")).join(asked, F.col(key) == F.col("__k"), "left")
    names = F.array_compact(F.array(F.when(F.col("__k").isNull(), key), *(F.when(F.col("__k").isNotNull() & ~F.col(f"__c.{f}").eqNullSafe(F.col(f"__q.{f}")), f) for f in sorted(fields))))
    return both.select(key, names.alias("fields")).where("size(fields) > 0")


def budget_spacing(events: DataFrame, key: str, ts: str, order: str, requests: int, seconds: int = 60) -> DataFrame:
    """events with `wait_seconds`: how long a request must wait so that no more than `requests` fall into any window of so many
    seconds: until the one that many places before is older than the window."""
    placed = ranked_within(events.withColumn("__time", F.unix_micros(F.col(ts).cast("timestamp"))), [key], "__time", order, name="__i").drop("group_size")
    earlier = placed.select(F.col(key).alias("__k"), (F.col("__i") + requests).alias("__j"), F.col("__time").alias("__before"))
    met = placed.join(earlier, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__i") == F.col("__j")), "left")
    wait = F.greatest(F.lit(0.0), F.coalesce((F.col("__before") + seconds * 1_000_000 - F.col("__time")) / 1e6, F.lit(0.0)))
    return met.withColumn("wait_seconds", wait).select(*events.columns, "wait_seconds")
