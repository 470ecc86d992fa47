"""Sources and sinks: driver tables, case views, CSV scan, model store."""
