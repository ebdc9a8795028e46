"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from brookwave.llm import chat_formatting, url_filters
from brookwave.llm.chat_formatting import op9_chat_formatting
from brookwave.llm.decontamination import op10_decontamination
from brookwave.llm.licences import op2_licences
from brookwave.llm.lm_scoring import op3_lm_scoring
from brookwave.llm.near_duplicates import op5_near_duplicates
from brookwave.llm.packing import op6_packing
from brookwave.llm.quality_classifier import op8_quality_classifier
from brookwave.llm.quality_rules import op4_quality_rules
from brookwave.llm.toxicity import op7_toxicity
from brookwave.llm.url_filters import op1_url_filters

QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_licences, op3_lm_scoring, op4_quality_rules, op5_near_duplicates, op6_packing, op7_toxicity, op8_quality_classifier, op9_chat_formatting, op10_decontamination)
}
SQL = {"op1_url_filters": url_filters.SQL, "op9_chat_formatting": chat_formatting.SQL}
