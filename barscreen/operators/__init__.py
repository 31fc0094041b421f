"""DataFrame operators: rolling windows, keyed writes, bans, quality and lookups."""
