"""See the package docstring of veilframe."""
