"""Part of tarifflens."""
