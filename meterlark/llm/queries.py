"""The corpus queries and their SQL."""

from __future__ import annotations

from . import bpe, collocations, exact_dedup, license_scan, line_dedup, merkle, packing, quality, sharding, simhash, token_counts, topk, warc_zip

QUERIES = {
    "op1_license_join": license_scan.op1_license_join,
    "op2_digest_index": exact_dedup.op2_digest_index,
    "op3_pivot_simhash": simhash.op3_pivot_simhash,
    "op4_rank_queue": bpe.op4_rank_queue,
    "op5_segment_lines": line_dedup.op5_segment_lines,
    "op6_norm_sorted_search": topk.op6_norm_sorted_search,
    "op7_differencing_packs": packing.op7_differencing_packs,
    "op8_bradley_terry": quality.op8_bradley_terry,
    "op9_histogram_shards": sharding.op9_histogram_shards,
    "op10_resynchronised_counts": token_counts.op10_resynchronised_counts,
    "op11_path_copying": merkle.op11_path_copying,
    "op12_count_automata": collocations.op12_count_automata,
    "op13_zip_archives": warc_zip.op13_zip_archives,
}

ORACLE_SQL = {
    "op1_license_join": license_scan.oracle(),
    "op2_digest_index": exact_dedup.OP2_SQL,
    "op6_norm_sorted_search": topk.OP6_SQL,
    "op11_path_copying": merkle.OP11_SQL,
    "op12_count_automata": collocations.OP12_SQL,
    "op13_zip_archives": warc_zip.OP13_SQL,
}
