"""Training-data operators over ``documents`` and ``embeddings`` (README, "llm").

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
