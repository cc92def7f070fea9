"""Operators that prepare training corpora: sharding, decontamination, quality, token counts, licences,
near-duplicates, personal data, fingerprints, line dedup and BPE. Nothing else in the library imports this package."""
