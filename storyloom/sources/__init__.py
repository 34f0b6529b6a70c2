"""sources of the character-graph pipeline."""
