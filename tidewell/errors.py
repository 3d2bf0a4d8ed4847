"""What callers can catch."""


class SpecError(ValueError):
    """A saved operation or its parameters are not valid."""


class MissingParams(SpecError):
    """Required parameters have no value; names holds them in order."""

    def __init__(self, names):
        self.names = sorted(set(names))
        super().__init__(f"missing parameters: {', '.join(self.names)}")


class AccessDenied(PermissionError):
    """The operation needs an identity and there is none."""
