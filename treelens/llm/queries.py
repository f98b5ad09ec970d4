"""The queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treelens.llm import oracle
from treelens.llm.bpe import op12_byte_bpe
from treelens.llm.html import op9_html_extraction
from treelens.llm.jaccard import op3_ngram_jaccard_join
from treelens.llm.language import op4_language_id
from treelens.llm.licenses import op1_license_scan
from treelens.llm.lines import op2_line_dedup
from treelens.llm.merkle import op13_merkle_manifest
from treelens.llm.mixing import op5_mixing
from treelens.llm.packing import op6_packing
from treelens.llm.quality import op10_quality_rules
from treelens.llm.trie import op11_conversation_trie
from treelens.llm.vectors import op8_embedding_near_dedup
from treelens.llm.warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_line_dedup": op2_line_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# The rules, hashes and trained models of the others are not SQL; tests compare
# them with brute force, round trips and held-out rows.
ORACLE: dict[str, str] = {
    "op3_ngram_jaccard_join": oracle.JACCARD,
    "op7_warc": oracle.WARC,
    "op8_embedding_near_dedup": oracle.VECTORS,
    "op11_conversation_trie": oracle.TRIE,
    "op13_merkle_manifest": oracle.MERKLE,
}
