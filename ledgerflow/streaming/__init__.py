"""Reserved. The blueprint has no streaming operator, so nothing is built here."""
