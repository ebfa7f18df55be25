"""Operators for building training corpora: packing, PII, language, licences, decontamination, dedup, WARC, HTML, quality."""
