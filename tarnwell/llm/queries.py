"""The operators' queries over the given tables, and the SQL that the expressible ones equal."""

from __future__ import annotations

from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import OP8_SQL, op8_decontamination
from .importance_resampling import OP12_SQL, op12_importance_resampling
from .jaccard_join import op3_jaccard_join
from .language_id import op9_language_id
from .mixing import OP4_SQL, op4_mixing
from .periodic_runs import OP11_SQL, op11_periodic_runs
from .pseudo_likelihood import op2_pseudo_likelihood
from .quality_classifier import op6_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .simhash_dedup import op13_simhash_dedup
from .substring_dedup import op7_substring_dedup
from .token_output import op10_token_output

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_pseudo_likelihood": op2_pseudo_likelihood,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_mixing": op4_mixing,
    "op5_chat_format": op5_chat_format,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_token_output": op10_token_output,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_simhash_dedup": op13_simhash_dedup,
}

ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op4_mixing": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}
