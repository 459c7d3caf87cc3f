"""The ten operators' queries and their SQL."""

from facetry.llm import op1_pieces, op2_tokens, op3_lines, op4_secrets, op5_embeddings, op6_quality, op7_simhash, op8_lm, op9_minhash, op10_mixing

MODULES = (op1_pieces, op2_tokens, op3_lines, op4_secrets, op5_embeddings, op6_quality, op7_simhash, op8_lm, op9_minhash, op10_mixing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: q for m in MODULES for k, q in m.SQL.items()}
