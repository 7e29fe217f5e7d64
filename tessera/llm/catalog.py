"""The queries of this subpackage and their SQL, as far as SQL expresses them."""

from __future__ import annotations

from tessera.llm.additive_ann import op8_additive_ann
from tessera.llm.bpe import op7_bpe_codec
from tessera.llm.edit_counts import op4_edit_counts
from tessera.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from tessera.llm.language_id import op3_language_id
from tessera.llm.mixing import op1_mix_sources
from tessera.llm.simhash import op5_simhash_dedup
from tessera.llm.sparse_suffixes import OP10_SQL, op10_repeated_spans
from tessera.llm.toxicity import op6_toxicity
from tessera.llm.warc_revisits import OP2_SQL, op2_warc_revisits

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_warc_revisits, op3_language_id, op4_edit_counts, op5_simhash_dedup, op6_toxicity, op7_bpe_codec,
        op8_additive_ann, op9_exact_dedup, op10_repeated_spans,
    )
}
ORACLE_SQL = {"op2_warc_revisits": OP2_SQL, "op9_exact_dedup": OP9_SQL, "op10_repeated_spans": OP10_SQL}
