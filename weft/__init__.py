"""Rule queries over named binary relations, on Spark."""

from .engine import Engine, Report
from .errors import AnalysisError, RuleError, RuleSyntaxError
from .sources.catalog import Catalog

__all__ = ["AnalysisError", "Catalog", "Engine", "Report", "RuleError", "RuleSyntaxError"]
