"""A Spark-native transactional full-text search engine."""

from .errors import Corrupt, Error, InvalidInput, TransactionClosed
from .operators.query import All, And, Column, Near, Not, Or, Phrase, Prefix, Query, SearchHit, SearchOptions, SearchResult, SearchStats, Term, query
from .sources.store import Database, DatabaseConfig, Transaction

__all__ = [
    "All", "And", "Column", "Corrupt", "Database", "DatabaseConfig", "Error", "InvalidInput", "Near", "Not", "Or", "Phrase", "Prefix", "Query",
    "SearchHit", "SearchOptions", "SearchResult", "SearchStats", "Term", "Transaction", "TransactionClosed", "query",
]
