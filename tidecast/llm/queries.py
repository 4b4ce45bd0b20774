"""Registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from tidecast.llm import align_leaks, bottom_k, chat_grammar, flow_mix, host_rules, merkle_blocks, passage_attention, period_runs, secret_index, tag_paths, token_arrow, toxic_fm, warc_derive
from tidecast.llm.words import table

QUERIES = {
    "op1_align_leaks": lambda spark, sf_dir: align_leaks.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op2_tag_paths": lambda spark, sf_dir: tag_paths.query(table(spark, sf_dir, "pages")),
    "op3_flow_mix": lambda spark, sf_dir: flow_mix.query(table(spark, sf_dir, "documents")),
    "op4_bottom_k": lambda spark, sf_dir: bottom_k.query(table(spark, sf_dir, "documents")),
    "op5_toxic_fm": lambda spark, sf_dir: toxic_fm.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_chat_grammar": lambda spark, sf_dir: chat_grammar.query(table(spark, sf_dir, "conversations")),
    "op7_warc_derive": lambda spark, sf_dir: warc_derive.query(table(spark, sf_dir, "pages")),
    "op8_token_arrow": lambda spark, sf_dir: token_arrow.query(table(spark, sf_dir, "documents")),
    "op9_secret_index": lambda spark, sf_dir: secret_index.query(table(spark, sf_dir, "documents")),
    "op10_host_quality": lambda spark, sf_dir: host_rules.query(table(spark, sf_dir, "documents")),
    "op11_merkle_blocks": lambda spark, sf_dir: merkle_blocks.query(table(spark, sf_dir, "documents")),
    "op12_passage_attention": lambda spark, sf_dir: passage_attention.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_period_runs": lambda spark, sf_dir: period_runs.query(table(spark, sf_dir, "documents")),
}
ORACLES = {"op6_chat_grammar": chat_grammar.ORACLE, "op10_host_quality": host_rules.ORACLE, "op11_merkle_blocks": merkle_blocks.ORACLE, "op13_period_runs": period_runs.ORACLE}
