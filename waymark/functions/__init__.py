"""Column functions for labels, geometry and calendars."""
