"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, htmltext, langid, licenses, neighbours, packing, shards, simhash, urlfilter, warc

QUERIES = {
    "op1_language": langid.op1_language,
    "op2_warc": warc.op2_warc,
    "op3_licenses": licenses.op3_licenses,
    "op4_text": htmltext.op4_text,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_packing": packing.op6_packing,
    "op7_shards": shards.op7_shards,
    "op8_simhash": simhash.op8_simhash,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op2_warc": warc.SQL, "op7_shards": shards.SQL, "op9_url_filter": urlfilter.SQL, "op10_decontaminate": decontaminate.SQL}
