"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .bucket_refinement import op6_bucket_refinement
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .fmindex import op5_fm_index
from .langid import op1_langid
from .lloyd import OP13_SQL, op13_lloyd
from .minhash import op7_minhash
from .packing import op8_packing
from .pfair import op4_pfair_mix
from .quality import op12_quality
from .resampling import OP11_SQL, op11_resampling
from .syncmers import op9_syncmers
from .templates import op3_templates
from .toxicity import op10_toxicity

QUERIES = {
    "op1_langid": op1_langid,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_templates": op3_templates,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_fm_index": op5_fm_index,
    "op6_bucket_refinement": op6_bucket_refinement,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_syncmers": op9_syncmers,
    "op10_toxicity": op10_toxicity,
    "op11_resampling": op11_resampling,
    "op12_quality": op12_quality,
    "op13_lloyd": op13_lloyd,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op11_resampling": OP11_SQL, "op13_lloyd": OP13_SQL}
