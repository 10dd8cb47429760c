"""The queries of the training-data operators, by the names under which they are registered, and their SQL."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import sql


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is, on the driver and on every executor."""
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned

    return scanned(_table(spark, sf_dir, "documents"))


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scanned_within

    return scanned_within(_table(spark, sf_dir, "documents"))


def variants() -> list[tuple[int, str, str]]:
    """(negative id, licence, text): the known licences wrapped anew, in capitals, respelled, and under someone's copyright."""
    from .licenses import KNOWN, forms

    out = []
    for license_id, text in dict(reversed(forms())).items():
        license_id = min(i for i, t in KNOWN.items() if t == text) if text in KNOWN.values() else license_id
        wrapped = ["\n".join(textwrap.fill(line, n) if not line.lower().lstrip().startswith("copyright") else line for line in text.split("\n")) for n in (61, 80)]
        swapped = re.sub(r"\bLicense\b", "Licence", text).replace("permission", "Permission").replace("recognize", "recognise").replace('"', "''")
        held = f"Copyright (c) 1999-2020 Some Body <some@example.org>\nAll rights reserved.\n\n{text}"
        stated = [f"{line}\n\n{text}" for line in ("Copyright The Foo Authors", "Copyright by Foo Inc., 2019", "© Foo Inc.", "Copyright 2019 Foo Inc.,\nBar Ltd. and\nothers", "SPDX-License-Identifier: Other-1.0")]
        out += [(license_id, t) for t in (*wrapped, text.upper(), swapped, held, *stated)]
    return [(-k - 1, *x) for k, x in enumerate(out)]


def op3_license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text scans over documents and variants of the known licences: every variant is found, as nothing else."""
    from .licenses import scanned

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    more = spark.createDataFrame([(i, text) for i, _, text in variants()], "doc_id long, text string")
    return scanned(docs.union(more)).select("doc_id", "license_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import Verdicts

    return Verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).report()


#: Risk and chance at which the few labels of the small tables certify cutoffs.
LENIENT = (0.4, 0.2)


def op5_quality_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5_quality_rules, at a risk so high that some hundred labels certify cutoffs: shows learned cutoffs at work."""
    from .quality_rules import Verdicts

    return Verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), risk=LENIENT[0], delta=LENIENT[1]).report()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identified

    docs = _table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded_digests

    return encoded_digests(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fresh_path
    from .token_counts import token_counts

    docs, path, cache = _table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), fresh_path(spark, "token-counts")
    token_counts(docs.where("lang = 'en'"), path, cache)  # a first delivery fills the cache; its texts are hits among all documents
    return token_counts(docs, path, cache)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_packing, op3_license_scan, op3_license_notices, op3_license_variants, op4_exact_dedup, op5_quality_rules, op5_quality_certificates, op6_bpe, op7_token_counts, op8_warc, op9_html_extraction, op10_simhash_near_dedup, op11_embedding_near_dedup, op12_vector_codes, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": sql.licenses(), "op3_license_variants": sql.license_variants(), "op4_exact_dedup": sql.EXACT_DEDUP, "op5_quality_rules": sql.quality_rules(), "op5_quality_certificates": sql.quality_rules(*LENIENT), "op8_warc": sql.WARC, "op11_embedding_near_dedup": sql.EMBEDDING_DEDUP, "op12_vector_codes": sql.vector_codes(), "op13_spelling_variants": sql.SPELLING}
