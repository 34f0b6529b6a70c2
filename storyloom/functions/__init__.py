"""Column functions of the character-graph pipeline."""
