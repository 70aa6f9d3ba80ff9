"""The opN_<name> queries and their SQL."""

from __future__ import annotations

from . import (
    ann, embed_dedup, html_extract, line_dedup, lm_score, mixing, ngram_join, packing, periodic_runs, pipeline, quality, suffix_dedup, url_filter,
    whitening,
)


def queries():
    return {
        "pipeline": pipeline.run,
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_embed_dedup": embed_dedup.op2_embed_dedup,
        "op3_packing": packing.op3_packing,
        "op4_mixing": mixing.op4_mixing,
        "op5_html_extract": html_extract.op5_html_extract,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_quality": quality.op9_quality,
        "op10_ann": ann.op10_ann,
        "op11_whitening": whitening.op11_whitening,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql():
    own = {"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {}
    return own | {"op2_embed_dedup": embed_dedup.SQL, "op4_mixing": mixing.SQL, "op7_ngram_join": ngram_join.SQL, "op13_line_dedup": line_dedup.SQL}
