"""Physical building blocks: per-image and per-tile execution, fixpoints, components, cost rules."""
