"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .chat import OP4_SQL, op4_chat_format
from .decontamination import OP8_SQL, op8_decontamination
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_extract import op2_html_text
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op10_mixing
from .ngram_join import op6_ngram_join
from .passages import op9_passage_dedup
from .quality import op7_quality_rules
from .secrets import op5_secret_scan
from .spelling import OP11_SQL, op11_spelling_variants
from .suffix_groups import OP13_SQL, op13_suffix_dedup
from .token_shards import op3_token_ids


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_html_text": op2_html_text,
        "op3_token_ids": op3_token_ids,
        "op4_chat_format": op4_chat_format,
        "op5_secret_scan": op5_secret_scan,
        "op6_ngram_join": op6_ngram_join,
        "op7_quality_rules": op7_quality_rules,
        "op8_decontamination": op8_decontamination,
        "op9_passage_dedup": op9_passage_dedup,
        "op10_mixing": op10_mixing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_suffix_dedup": op13_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    out = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return out | {"op1_line_dedup": OP1_SQL, "op4_chat_format": OP4_SQL, "op8_decontamination": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
