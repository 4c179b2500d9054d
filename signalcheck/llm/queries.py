"""The registered queries of this subpackage, and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from signalcheck.llm import phrases, repair, topk
from signalcheck.llm.decontaminate import op3_decontaminate
from signalcheck.llm.extract import op8_extract
from signalcheck.llm.licenses import op10_licenses
from signalcheck.llm.packing import op9_packing
from signalcheck.llm.pii import op5_pii
from signalcheck.llm.quality import op2_quality
from signalcheck.llm.rules import op6_rules
from signalcheck.llm.simhash import op7_simhash
from signalcheck.llm.token_counts import op4_token_counts
from signalcheck.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality, op3_decontaminate, op4_token_counts, op5_pii,
        op6_rules, op7_simhash, op8_extract, op9_packing, op10_licenses,
        topk.op11_topk, repair.op12_repair, phrases.op13_phrases,
    )
}
#: The first ten return what a model, a vocabulary, a hash or the method's own labels decide, which SQL does not have.
ORACLE: dict[str, str] = {
    "op11_topk": topk.ORACLE_SQL,
    "op12_repair": repair.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
}
