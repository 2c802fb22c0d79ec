"""fleetlens: installed-base and sales analytics as Spark DataFrame jobs."""
