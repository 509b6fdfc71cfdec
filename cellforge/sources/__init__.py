"""Sources, sinks and seeded generators."""
