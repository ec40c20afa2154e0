"""See the package docstring; modules are imported directly."""
