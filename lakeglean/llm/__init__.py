"""Training-data operators: scoring, de-duplication, media, packing, filters, formatting, PII, decontamination."""
