"""DataFrame operators: intervals, detection, applying plans, catalogue, quality, telemetry."""
