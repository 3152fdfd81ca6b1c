"""Errors that users of the engine can meet."""


class EngineError(Exception):
    """The root of them."""


class UnsupportedFile(EngineError):
    """A file whose kind can't be read."""


class TablesMissing(EngineError):
    """Some, but not all, tables of a stored graph exist."""


class DuplicateDocument(EngineError):
    """A document of this name is in the graph, or twice in a batch."""


class UnknownDocument(EngineError):
    """A file name that the graph doesn't know."""


class IllogicalAction(EngineError):
    """Such as a search in an empty graph."""


class InvalidObject(EngineError):
    """A node, edge or property that breaks the model's rules."""


class TemplateMismatch(EngineError):
    """The values given aren't those that a template names."""


class ProviderFailure(EngineError):
    """A model gave nothing."""


class MissingCredentials(EngineError):
    """A provider's settings are neither given nor in the environment."""


class UnknownVisual(EngineError):
    """A visual element that is neither table nor figure."""
