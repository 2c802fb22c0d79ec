"""Multi-row operators: ranking, comparison, integrity checks, chat samples, rewards."""
