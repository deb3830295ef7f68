"""Queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pactlens.llm.centroids import OP11_SQL, op11_centroids
from pactlens.llm.decontaminate import op8_decontaminate
from pactlens.llm.fingerprints import op5_fingerprints
from pactlens.llm.langid import op9_language
from pactlens.llm.licenses import op1_licenses
from pactlens.llm.mixing import OP2_SQL, op2_mix_sources
from pactlens.llm.neardup import OP3_SQL, op3_near_dedup
from pactlens.llm.quality import op10_quality
from pactlens.llm.runs import OP13_SQL, op13_runs
from pactlens.llm.secrets import OP6_SQL, op6_secrets
from pactlens.llm.simhash import op12_simhash
from pactlens.llm.toxicity import op7_toxicity
from pactlens.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_mix_sources": op2_mix_sources,
    "op3_near_dedup": op3_near_dedup,
    "op4_warc": op4_warc,
    "op5_fingerprints": op5_fingerprints,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_language": op9_language,
    "op10_quality": op10_quality,
    "op11_centroids": op11_centroids,
    "op12_simhash": op12_simhash,
    "op13_runs": op13_runs,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_mix_sources": OP2_SQL,
    "op3_near_dedup": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_secrets": OP6_SQL,
    "op11_centroids": OP11_SQL,
    "op13_runs": OP13_SQL,
}
