"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

import corpus_pipeline
from rivulet.llm import langid, licenses, mixing, packing, pii, quality, simhash, topk, transport, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_langid": langid.op3_langid,
    "op4_topk": topk.op4_topk,
    "op5_pii": pii.op5_pii,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_transport": transport.op8_transport,
    "op9_packing": packing.op9_packing,
    "op10_licenses": licenses.op10_licenses,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op4_topk": topk.ORACLE, "op6_warc": warc.ORACLE, "op10_licenses": licenses.ORACLE}
