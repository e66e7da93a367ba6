"""The LLM map step: configuration, prompts, providers, batching, usage metrics."""
