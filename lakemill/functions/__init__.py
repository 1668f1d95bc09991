"""Part of lakemill."""
