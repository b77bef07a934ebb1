"""What the engine raises on purpose."""


class CadenzaError(Exception):
    """Base of all errors of the engine."""


class MissingBackend(CadenzaError):
    """A model's library or weights are not installed."""


class EmptyCollection(CadenzaError):
    """Nothing was left to work on."""
