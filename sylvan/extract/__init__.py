"""Source text to symbols and relations, one language family per module."""
