"""Query plans over the driver's tables: inputs, the query catalogue and oracle SQL."""
