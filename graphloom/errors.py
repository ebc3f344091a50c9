"""Exceptions of the engine."""


class GraphError(ValueError):
    """A request that the engine refuses; the message says what to write instead."""


class ConstraintViolation(GraphError):
    """A write that breaks a rule."""

    def __init__(self, constraint: str, detail: str = ""):
        super().__init__(f"{constraint}: {detail}" if detail else constraint)
        self.constraint, self.detail = constraint, detail
