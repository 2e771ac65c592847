"""The queries of this subpackage and the SQL for those that SQL can express."""

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .flac import op1_flac
from .language_model import op3_language_model
from .mixing import OP5_SQL, op5_mixing
from .quality import op8_quality
from .secrets import op2_secrets
from .sentence_pieces import op10_sentencepiece
from .simhash import op6_simhash
from .token_counts import op9_token_counts
from .url_filter import OP7_SQL, op7_url_filter

QUERIES = {
    "op1_flac": op1_flac,
    "op2_secrets": op2_secrets,
    "op3_language_model": op3_language_model,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE = {"op4_exact_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op7_url_filter": OP7_SQL}
