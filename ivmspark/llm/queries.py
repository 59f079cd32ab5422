"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .coder import op8_token_ids
from .kdtree import OP6_SQL, op6_topk
from .langid import op10_langid
from .lengths import op7_token_lengths
from .lines import OP4_SQL, op4_line_dedup
from .matroska import op1_matroska
from .mixing import OP2_SQL, op2_mixing
from .pieces import op9_pieces
from .simhash import op3_simhash
from .warc import OP5_SQL, op5_warc

QUERIES = {f.__name__: f for f in (op1_matroska, op2_mixing, op3_simhash, op4_line_dedup, op5_warc, op6_topk, op7_token_lengths, op8_token_ids, op9_pieces, op10_langid)}

ORACLE_SQL = {"op2_mixing": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_warc": OP5_SQL, "op6_topk": OP6_SQL}
