"""Operators for preparing training data at scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it; it can be deleted whole.
"""
