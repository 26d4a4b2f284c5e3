"""DataFrame -> DataFrame operators over chat tables."""
