"""The opN_ queries, and SQL for those that SQL can express."""

from __future__ import annotations

from navloom.llm.bpe import op8_bpe
from navloom.llm.html import op1_html
from navloom.llm.language import op3_language
from navloom.llm.media import op10_media
from navloom.llm.packing import op9_packing
from navloom.llm.quality import op7_quality
from navloom.llm.simhash import op6_simhash
from navloom.llm.substring import OP4_SQL, op4_substring
from navloom.llm.toxicity import op2_toxicity
from navloom.llm.warc import OP5_SQL, op5_warc


def queries() -> dict:
    return {f.__name__: f for f in (op1_html, op2_toxicity, op3_language, op4_substring, op5_warc, op6_simhash, op7_quality, op8_bpe, op9_packing, op10_media)}


def oracle_sql() -> dict:
    return {"op4_substring": OP4_SQL, "op5_warc": OP5_SQL}
