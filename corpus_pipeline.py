"""Corpus pipeline: toxicity, quality rules, near-duplicates, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept.
All but the last return the columns of ``documents``; what a stage rejects is gone.
"""

from __future__ import annotations

from opledger.llm import common
from opledger.llm.decontamination import keep_uncontaminated
from opledger.llm.near_duplicates import keep_one_of_each
from opledger.llm.packing import pack_documents
from opledger.llm.quality_rules import keep_passing
from opledger.llm.toxicity import keep_civil


def toxicity(spark, docs, sf_dir):
    """Documents that score below 0.5."""
    return keep_civil(docs, common.table(spark, sf_dir, "labels"))


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules keep."""
    return keep_passing(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class."""
    return keep_one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents without a benchmark window."""
    return keep_uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    """Pieces of documents, packed into sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The stages train models, compress and tokenize, which SQL does not express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = common.materialised(stage(spark, docs, sf_dir))
        if before is not None:
            common.dropped(before)
        before = docs
    return docs
