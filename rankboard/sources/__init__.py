"""Sources and sinks: directory JSON exports and catalog tables."""
