"""Exceptions of the query language and the JSON readers."""


class QueryError(ValueError):
    """A query that can't be read, resolved or run."""


class Untyped(QueryError):
    """A query that the typed lane can't express; the dynamic lane can run it on documents."""


class JsonError(ValueError):
    """Text that isn't JSON at the asked-for strictness."""
