"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op8_bpe
from .chunks import op4_chunks
from .dialogue import op13_dialogue
from .langid import op2_langid
from .negatives import op11_negatives
from .neardup import op7_neardup
from .packing import op9_packing
from .phrases import op12_phrases
from .pii import op5_pii
from .quality import op10_quality
from .secrets import op6_secrets
from .sql import NEARDUP, NEGATIVES, QUALITY, SECRETS
from .sharding import op1_sharding
from .toxicity import op3_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_langid": op2_langid,
    "op3_toxicity": op3_toxicity,
    "op4_chunks": op4_chunks,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_neardup": op7_neardup,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_negatives": op11_negatives,
    "op12_phrases": op12_phrases,
    "op13_dialogue": op13_dialogue,
}

#: Queries over tables other than documents.
OTHER_TABLES = ("op11_negatives", "op13_dialogue")

SQL = {"op6_secrets": SECRETS, "op7_neardup": NEARDUP, "op10_quality": QUALITY, "op11_negatives": NEGATIVES}
