"""Operators of a training-data pipeline over documents, pages, embeddings and conversations.

Nothing outside this folder imports it; ``queries.py`` lists what it registers.
"""
