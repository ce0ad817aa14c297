"""The registered queries of this subpackage and their SQL."""

import corpus_pipeline

from headwater.llm import cover, crf, histogram, licenses, omh, packing, quality, suffixes, urlfilter, wumanber

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_suffix_dedup": suffixes.query,
    "op2_url_filter": urlfilter.query,
    "op3_token_counts": histogram.query,
    "op4_packing": packing.query,
    "op5_license_scan": licenses.query,
    "op6_near_dedup": omh.query,
    "op7_quality_rules": quality.query,
    "op8_substring_dedup": cover.query,
    "op9_decontamination": wumanber.query,
    "op10_secret_scan": crf.query,
}

ORACLE = {
    "op2_url_filter": urlfilter.SQL,
    "op5_license_scan": licenses.sql(),
    "op7_quality_rules": quality.SQL,
    "op8_substring_dedup": cover.SQL,
    "op9_decontamination": wumanber.SQL,
}
