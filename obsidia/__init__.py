"""A PySpark engine for telemetry analytics: sources, operators, plans and streams over three core tables."""
