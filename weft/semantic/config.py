"""Configuration of an LLM map step."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import AnalysisError

FORMATS = ("JSON", "XML", "MARKDOWN", "COLUMN_ENCODED", "FTREE")
#: Tuples of a batch if none is asked for.
BATCH = 2048


@dataclass(frozen=True)
class MapConfig:
    prompt: str
    columns: tuple[str, ...]
    tuple_format: str = "JSON"
    capacities: dict[str, int] = field(default_factory=dict, hash=False)  # FTREE: values of an attribute in a window
    batch_size: int = BATCH
    model_name: str = "demo_model"
    model: str = "demo"
    provider: str = "demo"
    parameters: dict = field(default_factory=dict, hash=False)

    @staticmethod
    def parse(config: dict) -> MapConfig:
        fmt = str(config.get("tuple_format", "JSON")).upper()
        if fmt not in FORMATS:
            raise AnalysisError(f"unsupported tuple_format {fmt!r}; one of {', '.join(FORMATS)}")
        if not isinstance(config.get("prompt"), str):
            raise AnalysisError("LLM_MAP needs a 'prompt'")
        if "context_column" not in config:
            raise AnalysisError("LLM_MAP needs a 'context_column'")
        context = config["context_column"]
        capacities: dict[str, int] = {}
        batch = BATCH
        if fmt == "FTREE":
            if "batch_size" in config:
                raise AnalysisError("FTREE takes no 'batch_size': the capacities bound a batch")
            if not isinstance(context, dict):
                raise AnalysisError("for FTREE 'context_column' is an object: attribute to capacity")
            for name, n in context.items():
                if not isinstance(n, int) or isinstance(n, bool) or n < 1:
                    raise AnalysisError(f"the capacity of {name!r} must be a positive integer")
                capacities[name] = n
        else:
            if not isinstance(context, list) or not all(isinstance(c, str) for c in context):
                raise AnalysisError("'context_column' is a list of attributes")
            batch = config.get("batch_size", BATCH)
            if not isinstance(batch, int) or isinstance(batch, bool) or batch < 1:
                raise AnalysisError("'batch_size' must be a positive integer")
        if not context:
            raise AnalysisError("'context_column' is empty")
        known = {"tuple_format", "prompt", "context_column", "batch_size", "model_name", "model", "provider", "debug"}
        return MapConfig(
            config["prompt"], tuple(context), fmt, capacities, batch, config.get("model_name", "demo_model"), config.get("model", "demo"), str(config.get("provider", "demo")),
            {k: v for k, v in config.items() if k not in known},
        )
