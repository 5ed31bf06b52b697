"""Named queries built from the operators: panels, examples, console, registry."""
