"""operators of the character-graph pipeline."""
