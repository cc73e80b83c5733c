"""Errors that are raised while a plan is built."""


class EngineError(ValueError):
    """code: a stable name; field: the parameter at fault, if one is."""

    def __init__(self, code: str, message: str, field: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.field = code, field
