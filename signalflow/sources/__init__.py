"""Sources and sinks: landed feeds, pages, config, and adapters for given tables."""
