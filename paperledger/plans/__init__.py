"""Plan-level helpers and the views the registered queries read."""
