"""The operators of this package as queries, and SQL where SQL can say it."""

from vitaframe.llm.bpe import op2_bpe
from vitaframe.llm.compact_windows import op5_substring_dedup
from vitaframe.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from vitaframe.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from vitaframe.llm.jaccard_join import op10_jaccard_join
from vitaframe.llm.language_id import op8_language_id
from vitaframe.llm.mixing import OP6_SQL, op6_mixing
from vitaframe.llm.quality_rules import OP1_SQL, op1_quality_rules
from vitaframe.llm.simhash import op12_simhash
from vitaframe.llm.suffix_dedup import op7_suffix_dedup
from vitaframe.llm.toxicity import op9_toxicity
from vitaframe.llm.warc import OP4_SQL, op4_warc
from vitaframe.llm.whitening import op11_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc": op4_warc,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_mixing": op6_mixing,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {
    "op1_quality_rules": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op13_hard_negatives": OP13_SQL,
}
