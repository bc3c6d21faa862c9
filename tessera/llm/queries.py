"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import op2_warc as warc
from tessera.llm import op3_lines as line_dedup
from tessera.llm import op6_compaction as compaction
from tessera.llm import op12_filters as filters
from tessera.llm import op13_repair as repair
from tessera.llm.op1_mixing import op1_mixing
from tessera.llm.op2_warc import op2_warc
from tessera.llm.op3_lines import op3_lines
from tessera.llm.op4_spotsigs import op4_spotsigs
from tessera.llm.op5_language import op5_language
from tessera.llm.op6_compaction import op6_compaction
from tessera.llm.op7_quality import op7_quality
from tessera.llm.op8_packing import op8_packing
from tessera.llm.op9_byte_bpe import op9_byte_bpe
from tessera.llm.op10_jaccard import op10_jaccard
from tessera.llm.op11_descent import op11_descent
from tessera.llm.op12_filters import op12_filters
from tessera.llm.op13_repair import op13_repair

QUERIES = {f.__name__: f for f in (op1_mixing, op2_warc, op3_lines, op4_spotsigs, op5_language, op6_compaction, op7_quality, op8_packing, op9_byte_bpe, op10_jaccard, op11_descent, op12_filters, op13_repair)}

ORACLE_SQL: dict[str, str] = {"op2_warc": warc.ORACLE_SQL, "op3_lines": line_dedup.ORACLE_SQL, "op6_compaction": compaction.ORACLE_SQL, "op12_filters": filters.ORACLE_SQL, "op13_repair": repair.ORACLE_SQL}
