"""Analytics over agent telemetry: spans, traces, sessions, messages and metrics as Spark plans."""
