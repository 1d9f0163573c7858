"""Queries of the training-data operators, by the names the entry module registers."""

from __future__ import annotations

from opledger.llm import decontamination, licenses, urls
from opledger.llm.common import table
from opledger.llm.decontamination import decontaminate
from opledger.llm.extraction import extract_text
from opledger.llm.lm_scoring import score_texts
from opledger.llm.near_duplicates import near_duplicates
from opledger.llm.packing import pack_documents
from opledger.llm.quality_model import score_quality
from opledger.llm.quality_rules import quality_rules
from opledger.llm.toxicity import score_toxicity


def op1_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_table(spark))


def op6_url_filter(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.listed_urls(spark))


def op7_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_quality_rules, op3_html_extraction, op4_lm_scoring, op5_license_scan, op6_url_filter, op7_packing, op8_toxicity, op9_decontamination, op10_near_duplicates)}

ORACLE_SQL: dict[str, str] = {"op5_license_scan": licenses.ORACLE, "op6_url_filter": urls.ORACLE, "op9_decontamination": decontamination.ORACLE}
