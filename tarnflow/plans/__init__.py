"""From SQL text to plans, and what plans say about how they run."""
