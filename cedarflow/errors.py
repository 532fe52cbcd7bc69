"""Errors that a wrong query text, schema or call raises."""


class EngineError(Exception):
    """Base of all errors raised by this package."""


class SyntaxProblem(EngineError, ValueError):
    """A predicate, arithmetic or catalog text that cannot be parsed."""


class UnknownColumn(EngineError, KeyError):
    """A name that no input has."""


class AmbiguousColumn(EngineError, ValueError):
    """A name that both inputs of a join have."""


class TypeMismatch(EngineError, TypeError):
    """Operands whose types may not meet."""
