"""plans of the character-graph pipeline."""
