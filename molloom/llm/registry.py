"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .chat_trees import OP13_SQL, op13_chat_trees
from .context_mixing import op9_context_mixing
from .conversation_trie import OP11_SQL, op11_conversation_trie
from .language_id import op3_language_id
from .line_chunks import op4_line_chunks
from .mpeg_audio import op5_mpeg_audio
from .phrase_mining import OP12_SQL, op12_phrase_mining
from .piece_codec import op2_piece_codec
from .quality_compression import op10_quality_compression
from .simhash_pigeonhole import op8_simhash_pigeonhole
from .suffix_dedup import op1_suffix_dedup
from .token_orc import op7_token_orc
from .winnow_decontamination import OP6_SQL, op6_winnow_decontamination


def queries() -> dict:
    import corpus_pipeline

    found = [op1_suffix_dedup, op2_piece_codec, op3_language_id, op4_line_chunks, op5_mpeg_audio, op6_winnow_decontamination, op7_token_orc, op8_simhash_pigeonhole, op9_context_mixing, op10_quality_compression, op11_conversation_trie, op12_phrase_mining, op13_chat_trees]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_winnow_decontamination": OP6_SQL, "op11_conversation_trie": OP11_SQL, "op12_phrase_mining": OP12_SQL, "op13_chat_trees": OP13_SQL}
