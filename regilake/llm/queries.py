"""Queries of the training-data operators for ``__spark_entry__.py``: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import (bpe, chat, decontaminate, drift_means, kneser_ney, lexical_search, license_scan, mixing, near_join,
               quality_rules, token_file, url_graph, warc)

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_url_graph": url_graph.op2_url_graph,
    "op3_chat": chat.op3_chat,
    "op4_near_join": near_join.op4_near_join,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_kneser_ney": kneser_ney.op6_kneser_ney,
    "op7_token_file": token_file.op7_token_file,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_warc_revisits": warc.op10_warc_revisits,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_mix_sources": mixing.op12_mix_sources,
    "op13_drift_means": drift_means.op13_drift_means,
}

#: DuckDB twins. The others have no SQL form and are tested against brute force in tests/llm.
ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_url_graph": url_graph.ORACLE,
    "op3_chat": chat.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_warc_revisits": warc.ORACLE,
    "op11_lexical_search": lexical_search.ORACLE,
    "op13_drift_means": drift_means.ORACLE,
}
