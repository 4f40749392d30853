"""Operations of a training-data pipeline: decontamination, extraction, filters, near duplicates, search, tokens."""
