"""The registered queries, by subject."""

from . import catalog_queries, chunk_queries, graph_queries, job_queries, retrieval_queries, text_queries

BOOKS = (text_queries.book, catalog_queries.book, retrieval_queries.book, chunk_queries.book, graph_queries.book, job_queries.book)
