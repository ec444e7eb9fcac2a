"""Training-data operators: filtering, sharding, packing, scanning, deduplication and mixing of text corpora.

Nothing outside this package (and ``corpus_pipeline.py``, which belongs to it) imports it.
"""
