"""Training-data operators over documents and embeddings.

Nothing outside this folder imports it (``__spark_entry__`` adds its
queries when it is present). Each module is one operator with its own
general interface; ``queries`` holds the thin registered queries.
"""
