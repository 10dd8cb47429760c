"""Exact deduplication by content-defined chunk recipes.

A text is cut at places that its content sets, with a least and a greatest length, so that equal texts have equal chunks and
texts that share a passage share most of its chunks. A cut may stand, in whatever script, after two characters in a row that
each equal the one two places before; where an ideograph, kana or Hangul syllable follows, of which there are too many to repeat
so, after one; and after a word whose last three characters are of Latin-1 with code points 0, 1 and 2 modulo 3. A chunk's candidate identifier is its 64-bit digest. One shuffle brings the chunks together by
digest, combined before it, and verifies that a digest stands for one content; a second content of the same digest gets an
ordinal of its own, and (digest, ordinal) is the verified identifier. A text's recipe is the ordered list of its chunks'
identifiers. Texts are equal if and only if their recipes are. Recipes are written with the rows' ids and digests; from there on
only these move: a long text travels once.

Nulls: a null text counts as empty, a null id orders below any other. Empty texts form one group. Repeated rows (the same
id and text) are rows of their group; of ties for the largest id exactly one row stays. Extra columns don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, keyed_summary, row_key, salt_of, written

#: Least and greatest code points of a chunk that doesn't end the text.
LEAST, MOST = 512, 2048


def _residue(r: int) -> str:
    """The set of printable Latin-1 characters whose code point is r modulo 3."""
    return "[" + "".join(f"\\x{c:02x}" for c in (*range(33, 127), *range(161, 256)) if c % 3 == r) + "]"


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they are the text. An empty text has none."""
    cut = r"(?:(.).\1[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|(.)(.)\2\3|" + "".join(map(_residue, range(3))) + r"\s)"
    pattern = rf"(?s).{{{LEAST - 4},{MOST - 4}}}?{cut}|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def digest_clashes(pieces: DataFrame) -> DataFrame:
    """pieces(h, chunk) -> (h, chunk, ordinal), ordinal 1 and up: further contents of digests that stand for several."""
    contents = pieces.groupBy("h").agg(F.sort_array(F.collect_set("chunk")).alias("contents")).where(F.size("contents") > 1)
    return contents.select("h", F.posexplode("contents").alias("ordinal", "chunk")).where("ordinal > 0").select("h", "chunk", "ordinal")


def with_recipes(rows: DataFrame, digest=F.xxhash64) -> DataFrame:
    """rows(__id, __text, further columns) -> a written table of __uid, __id, the further columns, text_sha256 and __recipe:
    the text's ordered verified chunk identifiers."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    further = [c for c in rows.columns if c != "__text"]

    def plain(rows: DataFrame) -> DataFrame:
        return rows.select("__uid", *further, F.sha2(text, 256).alias("text_sha256"), F.transform(chunks(text), lambda c: digest(c)).alias("__recipe"))

    pieces = rows.select(F.explode(chunks(text)).alias("chunk")).select(digest("chunk").alias("h"), "chunk")
    clashes = written(digest_clashes(pieces), "chunk-clashes")
    numbered = rows.withColumn("__uid", F.monotonically_increasing_id())
    if clashes.isEmpty():  # every digest is verified to stand for one content
        return written(plain(numbered), "recipes")
    numbered = written(numbered, "numbered-texts")
    placed = numbered.select("__uid", F.posexplode(chunks(text)).alias("at", "chunk")).withColumn("h", digest("chunk"))
    odd = placed.join(clashes, ["h", "chunk"]).groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("at", "ordinal"))).alias("__odd"))
    ordinals = F.flatten(F.transform(F.coalesce("__odd", F.array().cast("array<struct<at:int,ordinal:int>>")), lambda x: F.array(x["at"].cast("long"), x["ordinal"].cast("long"))))
    # the list of digests, a mark, then place and ordinal of each chunk that isn't its digest's first content
    return written(plain(numbered).join(odd, "__uid", "left").withColumn("__recipe", F.concat("__recipe", F.array(F.lit(-1).cast("long")), ordinals)).drop("__odd"), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.xxhash64) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256). digest: a column function to long, for tests."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    return _groups(rows, digest).select(F.col("__id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def keep_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each group that stays, with all its columns."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), row_key(id_col, text_col).alias("__key"))
    return keep_rows(docs, _groups(rows).where("kept"), id_col, text_col)


def _groups(rows: DataFrame, digest=F.xxhash64) -> DataFrame:
    """rows(__id, __text, further columns that pass through)"""
    further = [c for c in rows.columns if c not in ("__id", "__text")]
    keyed = with_recipes(rows, digest).withColumn("__salt", salt_of(F.col("__uid")))
    best = F.struct("__id", "__uid")
    groups = keyed_summary(
        keyed, ["__recipe"], "__salt",
        {"best": F.max(best), "n": F.count(F.lit(1))},
        {"best": F.max("best"), "n": F.sum("n")},
    )
    return keyed.join(groups, ["__recipe", "__salt"]).select(
        "__id", *further,
        F.col("best.__id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("__uid") == F.col("best.__uid")).alias("kept"),
        "text_sha256",
    )
