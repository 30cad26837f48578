"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
