"""Training-data operators: tokens, near-duplicates, filters and packing over whole corpora.

Nothing outside this subpackage (``corpus_pipeline.py`` counts as part of it) imports it.
"""
