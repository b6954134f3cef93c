from . import archives, configs, office, sinks, sqlite, tabular  # noqa: F401
