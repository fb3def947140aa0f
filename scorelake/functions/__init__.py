"""Part of scorelake."""
