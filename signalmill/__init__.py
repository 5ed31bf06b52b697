"""signalmill: OpenTelemetry analytics expressed as Spark DataFrame operators."""
