"""riskframe — prompt-risk assessment and guardrail evaluation as Spark jobs."""

__version__ = "0.1.0"
