"""Queries of the operators: each over its whole table with production
parameters. ``oracles.ORACLE`` has the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tipscope.llm.base import table


def op2_patience_alignment(spark, sf_dir):
    from tipscope.llm.line_dedup import report
    return report(table(spark, sf_dir, "documents"))


def op3_ownership_scan(spark, sf_dir):
    from tipscope.llm.secrets import digest, scan
    return digest(scan(table(spark, sf_dir, "documents")))


def op4_co_training(spark, sf_dir):
    from tipscope.llm.cotrain import score
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_raking(spark, sf_dir):
    from tipscope.llm.mixing import report
    return report(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark, sf_dir):
    from tipscope.llm.ngram_join import jaccard_classes
    return jaccard_classes(table(spark, sf_dir, "documents")).select(
        "id", "n_shingles", "component_id", "class_id").withColumnRenamed("id", "doc_id")


def op7_nb_ngrams(spark, sf_dir):
    from tipscope.llm.toxicity import score
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_block_lstm(spark, sf_dir):
    from tipscope.llm.html_text import main_text
    return main_text(table(spark, sf_dir, "pages"))


def op9_line_frequency(spark, sf_dir):
    from tipscope.llm.line_rules import quality_report
    return quality_report(table(spark, sf_dir, "documents")).drop("text_hash", "host").withColumnRenamed(
        "id", "doc_id")


def op1_backoff_automaton(spark, sf_dir):
    from tipscope.llm.backoff_lm import score
    return score(table(spark, sf_dir, "documents"))


def op10_containment_search(spark, sf_dir):
    """Contaminated documents and the items that they hold."""
    from tipscope.llm.base import HASH, ID
    from tipscope.llm.decontaminate import contained
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop(
        HASH).withColumnRenamed(ID, "doc_id")


def op11_slot_pivot(spark, sf_dir):
    from tipscope.llm.merkle import report
    return report(table(spark, sf_dir, "documents"))


def op12_hadamard_codes(spark, sf_dir):
    from tipscope.llm.vector_codes import report
    return report(table(spark, sf_dir, "embeddings"))


def op13_signature_rules(spark, sf_dir):
    from tipscope.llm.license_scan import report
    return report(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (
        op1_backoff_automaton, op2_patience_alignment, op3_ownership_scan, op4_co_training, op5_raking,
        op6_ngram_jaccard, op7_nb_ngrams, op8_block_lstm, op9_line_frequency, op10_containment_search,
        op11_slot_pivot, op12_hadamard_codes, op13_signature_rules)}


def oracle_sql():
    from tipscope.llm.oracles import ORACLE
    return dict(ORACLE)
