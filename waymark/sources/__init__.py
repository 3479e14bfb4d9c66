"""Readers and writers of GeoJSON routes and GTFS feeds."""
