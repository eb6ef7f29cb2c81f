"""Errors that statements raise. Messages are part of the interface."""


class GraphError(Exception):
    """Any error of a statement."""


class SyntaxError_(GraphError):
    """The text is not a statement."""


class BindError(GraphError):
    """A name, type or use that the statement's graph doesn't have or allow."""


class CatalogError(GraphError):
    """A graph, label, index or property that exists, or doesn't."""
