"""Business definitions, reports, the query catalogue and score rollups."""
