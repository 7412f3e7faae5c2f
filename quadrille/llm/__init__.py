"""Corpus operators for training data: fingerprints, BPE, near-duplicates, packing, toxicity, chats, language, PII, HTML, nearest neighbours."""
