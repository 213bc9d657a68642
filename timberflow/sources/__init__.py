"""From raw inputs (text, JSON records, OTLP payloads) to canonical log rows."""
