"""Registry of the operators' queries and of the SQL that some of them have."""

from __future__ import annotations

from recordlens.llm.bpe import op10_byte_bpe
from recordlens.llm.chat import op7_chat_format
from recordlens.llm.htmltext import op5_html_text
from recordlens.llm.imatch import op6_imatch
from recordlens.llm.lines import OP3_SQL, op3_line_dedup
from recordlens.llm.negatives import OP13_SQL, op13_summa_negatives
from recordlens.llm.nndescent import op8_nndescent
from recordlens.llm.packing import op1_packing
from recordlens.llm.quality import op2_quality
from recordlens.llm.ranking import OP12_SQL, op12_quantised_search
from recordlens.llm.relz import op4_relz
from recordlens.llm.simhash import op9_simhash
from recordlens.llm.transducer import op11_transducer_bpe

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_relz": op4_relz,
    "op5_html_text": op5_html_text,
    "op6_imatch": op6_imatch,
    "op7_chat_format": op7_chat_format,
    "op8_nndescent": op8_nndescent,
    "op9_simhash": op9_simhash,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_transducer_bpe": op11_transducer_bpe,
    "op12_quantised_search": op12_quantised_search,
    "op13_summa_negatives": op13_summa_negatives,
}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op12_quantised_search": OP12_SQL, "op13_summa_negatives": OP13_SQL}
