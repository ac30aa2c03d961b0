"""Plans over the driver's tables: a market view, the query catalogue and its oracles."""
