"""Input tables of the delegation reports."""
