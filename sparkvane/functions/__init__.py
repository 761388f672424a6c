"""Part of the sparkvane engine."""
