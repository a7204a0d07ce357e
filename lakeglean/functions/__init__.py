"""Part of lakeglean."""
