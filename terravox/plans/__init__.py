"""Physical-plan helpers: sessions, written checkpoints, size-checked broadcasts."""
