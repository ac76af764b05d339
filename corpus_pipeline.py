"""The corpus pipeline: five operators, one after the other, over whole tables.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last one returns the packed pieces.

Nulls and odd cases: null and empty texts fail the quality rules. Documents with a null id are judged like others, go if a
document with an id is a near duplicate, and keep all their words. Rows repeated with one id and text stay or go together.
Texts of any length are treated whole. An empty table gives an empty result, missing labels a classifier that keeps all it is
unsure of. Further columns pass through all stages but the last, whatever their names but for a leading underscore.
"""

from __future__ import annotations

from veilwright.llm import compression_quality, packing, quality_rules, queries, simhash, substrings
from veilwright.sources.scratch import remove, run_folder, scratch_path


def quality_rules_stage(spark, docs, sf_dir):
    """Documents that the rules' posterior (or a base rule) rejects go."""
    return quality_rules.keep_good(docs)


def quality_classifier_stage(spark, docs, sf_dir):
    """Documents that score below the threshold go.

    The classifier is fitted on the labelled documents of the whole corpus: after the first stage few bad ones are left.
    """
    model = compression_quality.fit(queries.load(spark, sf_dir, "documents"), queries.load(spark, sf_dir, "labels"))
    return compression_quality.keep_good(docs, model)


def near_duplicates_stage(spark, docs, sf_dir):
    """The document with the smallest doc_id of each group of near-duplicates stays."""
    return simhash.keep_first(docs, shingle=3, bits=2)


def substring_stage(spark, docs, sf_dir):
    """Words of long passages that an earlier document has too are cut out; all documents stay."""
    return substrings.rewrite(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents, in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, queries.public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL twin: the tokenizer and the fitted models are beyond SQL. tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows. What a stage writes on its way goes when its output is written, and that when the next one's is."""
    docs, before = queries.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        output = scratch_path(spark, name)
        with run_folder(spark, f"{name}_scratch"):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(output)
        docs = spark.read.schema(result.schema).parquet(output)
        if before:
            remove(spark, before)
        before = output
    return STAGES[-1][1](spark, docs, sf_dir)
