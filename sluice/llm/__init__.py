"""Training-data pipeline operators (line dedup, near-dedup, WARC, URL filters, PII, language, packing, fingerprints,
decontamination, toxicity).  Nothing else in the library imports this subpackage."""
