"""DataFrame operators: selection, geometry, timelines, tracking and metrics."""
