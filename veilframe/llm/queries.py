"""The queries of this subpackage and the SQL of those that DuckDB can run."""

from __future__ import annotations

from .bpe import op6_bpe
from .decontam import OP8_SQL, op8_decontamination
from .linededup import OP9_SQL, op9_line_dedup
from .media import op2_media
from .pii import op10_pii
from .quality import op7_quality
from .sharding import op5_sharding
from .simhash import op3_simhash
from .toxicity import op1_toxicity
from .urlfilter import OP4_SQL, op4_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii": op10_pii,
}
SQL = {"op4_url_filter": OP4_SQL, "op9_line_dedup": OP9_SQL, "op8_decontamination": OP8_SQL}
