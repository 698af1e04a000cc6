"""What a statement can fail with."""


class QueryError(ValueError):
    """The statement is well formed but asks for something that isn't allowed, or exceeds a limit."""


class ParseError(QueryError):
    """The statement is not in the language; ``at`` is the offset of the offending token."""

    def __init__(self, message: str, at: int):
        super().__init__(f"Query parse error: {message} at position {at}")
        self.at = at
