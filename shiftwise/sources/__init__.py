from shiftwise.sources.tables import Tables, conform

__all__ = ["Tables", "conform"]
