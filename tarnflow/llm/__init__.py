"""Training-data operators: ten operators over documents, conversations and embeddings.

Nothing else in the library imports this subpackage.
"""
