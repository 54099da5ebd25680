"""The engine's error."""


class EngineError(Exception):
    """A statement, name or value that the engine does not accept."""
