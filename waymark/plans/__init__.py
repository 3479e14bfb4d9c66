"""The registered queries: the operators over routes, labels and feeds that are derived from the given tables."""
