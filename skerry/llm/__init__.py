"""Training-data operators: packing, media, privacy, licences, language models,
vector hashing, tokenisation, repeated passages, toxicity and near-duplicates.

Nothing outside this subpackage imports it.
"""
