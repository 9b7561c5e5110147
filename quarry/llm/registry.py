"""The queries of this subpackage, and SQL for those that SQL can express."""

from quarry.llm.ann import op8_ann
from quarry.llm.chat import OP7_SQL, op7_chat
from quarry.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from quarry.llm.html import op9_html
from quarry.llm.langid import op4_langid
from quarry.llm.mixing import op2_mixing
from quarry.llm.neardup import OP6_SQL, op6_neardup
from quarry.llm.sentencepiece import op10_sentencepiece
from quarry.llm.sstable import op3_sstable
from quarry.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_sstable": op3_sstable,
    "op4_langid": op4_langid,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_neardup": op6_neardup,
    "op7_chat": op7_chat,
    "op8_ann": op8_ann,
    "op9_html": op9_html,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op6_neardup": OP6_SQL, "op7_chat": OP7_SQL}
