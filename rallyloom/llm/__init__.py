"""Training-data operators for document corpora.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
