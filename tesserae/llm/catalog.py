"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from .bpe import op5_bpe_transducer
from .licences import op8_licence_scan
from .linededup import op2_line_dedup
from .media import op9_media_columns
from .neighbours import op6_ivfpq_search
from .packing import op1_nnls_packing
from .quality import op4_quality_classifier
from .sharding import op10_histogram_shards
from .simhash import op3_simhash_trie
from .toxicity import op7_toxicity

LLM_QUERIES = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_simhash_trie": op3_simhash_trie,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_bpe_transducer": op5_bpe_transducer,
    "op6_ivfpq_search": op6_ivfpq_search,
    "op7_toxicity": op7_toxicity,
    "op8_licence_scan": op8_licence_scan,
    "op9_media_columns": op9_media_columns,
    "op10_histogram_shards": op10_histogram_shards,
}
LLM_SQL: dict[str, str] = {}
