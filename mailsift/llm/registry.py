"""Queries of the corpus operators, and SQL for those that SQL can express."""

from .bpe import op5_bpe
from .chat import OP10_SQL, op10_chat
from .decontaminate import OP8_SQL, op8_decontaminate
from .fim import OP13_SQL, op13_fim
from .html import op2_html
from .linededup import op3_linededup
from .lm import op6_lm
from .neardup import op9_bagminhash
from .neardup_sql import OP9_SQL
from .quality import op1_quality
from .secret_scan import OP11_SQL, op11_secrets
from .suffix import op4_suffix
from .warc import OP7_SQL, op7_warc
from .whiten import op12_whiten

QUERIES = {"op1_quality": op1_quality, "op2_html": op2_html, "op3_linededup": op3_linededup, "op4_suffix": op4_suffix, "op5_bpe": op5_bpe, "op6_lm": op6_lm, "op7_warc": op7_warc, "op8_decontaminate": op8_decontaminate, "op9_bagminhash": op9_bagminhash, "op10_chat": op10_chat, "op11_secrets": op11_secrets, "op12_whiten": op12_whiten, "op13_fim": op13_fim}
SQL = {"op7_warc": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_bagminhash": OP9_SQL, "op10_chat": OP10_SQL, "op11_secrets": OP11_SQL, "op13_fim": OP13_SQL}
