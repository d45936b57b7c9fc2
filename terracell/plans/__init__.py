"""Plans: operators put together for the driver's queries, each with its SQL counterpart."""
