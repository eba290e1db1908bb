"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, infill, mixing
from .audio import op6_mpeg_audio
from .chat import op1_chat_format
from .decontam import op5_decontamination
from .html import op2_html_text
from .infill import op13_fill_in_middle
from .jaccard import op7_ngram_jaccard
from .langid import op3_language_id
from .mixing import op11_mixing
from .packing import op10_packing
from .pii import op9_pii
from .quality import op8_quality
from .repair import op12_conversation_repair
from .repeats import op4_suffix_dedup


def queries() -> dict:
    found = [op1_chat_format, op2_html_text, op3_language_id, op4_suffix_dedup, op5_decontamination, op6_mpeg_audio, op7_ngram_jaccard, op8_quality, op9_pii, op10_packing, op11_mixing, op12_conversation_repair, op13_fill_in_middle]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.SQL, "op11_mixing": mixing.SQL, "op13_fill_in_middle": infill.SQL}
