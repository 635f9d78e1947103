"""The registered queries of this subpackage and the SQL that DuckDB can check them with."""

from __future__ import annotations

from . import op10
from .op1 import op1_toxicity
from .op2 import op2_simhash
from .op3 import op3_near_dedup
from .op4 import op4_mixing
from .op5 import op5_line_dedup
from .op6 import op6_byte_bpe
from .op7 import op7_html_text
from .op8 import op8_warc
from .op9 import op9_sharding
from .op11 import op11_spelling
from .op12 import op12_whitening
from .op13 import op13_language

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_html_text": op7_html_text,
    "op8_warc": op8_warc,
    "op9_sharding": op9_sharding,
    "op10_search": op10.op10_search,
    "op11_spelling": op11_spelling,
    "op12_whitening": op12_whitening,
    "op13_language": op13_language,
}

ORACLE_SQL: dict[str, str] = {"op10_search": op10.SQL}
