"""The queries of this subpackage, by name."""

from __future__ import annotations

from .blocknames import OP5_SQL, op5_blocknames
from .bpe import op1_bpe
from .convtrie import OP13_SQL, op13_trie
from .langid import op2_langid
from .licenses import op3_licenses
from .linededup import OP11_SQL, op11_lines
from .middle import OP12_SQL, op12_middle
from .neardup import op6_neardup
from .ogg import op10_ogg
from .packing import op7_packing
from .passages import op9_passages
from .pii import op4_pii
from .urls import op8_urls

QUERIES = {f.__name__: f for f in (op1_bpe, op2_langid, op3_licenses, op4_pii, op5_blocknames, op6_neardup, op7_packing, op8_urls, op9_passages, op10_ogg, op11_lines, op12_middle, op13_trie)}
ORACLE_SQL = {"op5_blocknames": OP5_SQL, "op11_lines": OP11_SQL, "op12_middle": OP12_SQL, "op13_trie": OP13_SQL}
