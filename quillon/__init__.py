"""quillon: embedding, retrieval and telemetry analytics as PySpark DataFrame operators."""
