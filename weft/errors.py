"""Errors of the rule engine."""


class RuleError(ValueError):
    """Anything wrong with a rule before it runs."""


class RuleSyntaxError(RuleError):
    """The text is not a rule; ``position`` is the offset of what was not expected."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} (at position {position})")
        self.position = position


class AnalysisError(RuleError):
    """The rule is well-formed but does not fit the catalog, the column ordering or the sink."""
