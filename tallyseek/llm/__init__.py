"""Training-data operators: dedup, filters, decontamination and mixing over whole corpora."""
