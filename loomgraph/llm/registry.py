"""The corpus operators' queries, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from loomgraph.llm.host_suffix_array import op4_html_extraction
from loomgraph.llm.language_id import op2_language_id
from loomgraph.llm.mixing import OP3_SQL, op3_mixing
from loomgraph.llm.pii_surrogates import op1_pii_surrogates
from loomgraph.llm.quality_ledger import ablation_sql, op6_quality_rules, op6_sql, quality_ablation
from loomgraph.llm.sequence_packing import op8_sequence_packing
from loomgraph.llm.shard_table import op10_shard_table, op10_sql
from loomgraph.llm.simhash_index import op5_simhash
from loomgraph.llm.warc_salvage import op7_warc_salvage
from loomgraph.llm.winnowing import op9_winnowing


def queries() -> dict:
    return {
        "op1_pii_surrogates": op1_pii_surrogates,
        "op2_language_id": op2_language_id,
        "op3_mixing": op3_mixing,
        "op4_html_extraction": op4_html_extraction,
        "op5_simhash": op5_simhash,
        "op6_quality_rules": op6_quality_rules,
        "op7_warc_salvage": op7_warc_salvage,
        "op8_sequence_packing": op8_sequence_packing,
        "op9_winnowing": op9_winnowing,
        "op10_shard_table": op10_shard_table,
        "quality_ablation": quality_ablation,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op6_quality_rules": op6_sql(), "quality_ablation": ablation_sql(), "op10_shard_table": op10_sql()}
