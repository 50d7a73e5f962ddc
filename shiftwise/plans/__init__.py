"""Report plans: each is a function (Tables, typed arguments) -> DataFrame."""
