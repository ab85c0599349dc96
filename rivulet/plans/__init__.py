"""Plans: targets, the static grammar, dependencies, scheduling, and the engine."""
