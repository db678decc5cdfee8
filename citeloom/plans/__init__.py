"""Plans: the query catalogue, the yearly simulation and their state."""
