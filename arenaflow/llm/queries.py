"""The registered queries of the text operators: production parameters, whole tables, whole results."""

from __future__ import annotations

import public_tokenizers

from arenaflow.llm import (
    decontaminate, exact_topk, fill_middle, license_scan, mixing, near_dedup, parity_join, pii, quality, token_counts, url_filter, warc_store, whitening,
)
from arenaflow.llm.common import shared_dir, table
from arenaflow.llm.oracle import ORACLE


def op1_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_pii(spark, sf_dir):
    return pii.summary(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_warc(spark, sf_dir):
    import uuid

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.read_archive(spark, path, with_payload=False).drop("header")


def op8_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark, sf_dir):
    return exact_topk.top_products(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_parity_join(spark, sf_dir):
    return parity_join.join_classes(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened_entries(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark, sf_dir):
    return fill_middle.summary(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_decontaminate, op3_pii, op4_mixing, op5_quality, op6_url_filter, op7_warc, op8_license_scan, op9_exact_topk,
        op10_token_counts, op11_parity_join, op12_whitening, op13_fill_middle,
    )
}
