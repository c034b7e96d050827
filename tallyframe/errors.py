"""The engine's error classes."""


class ConfigError(Exception):
    """A configuration is missing or invalid."""


class SourceError(Exception):
    """A source's rows break its constraints."""


class TransformError(Exception):
    """A transform or an enrich step is unknown or fails."""


class ExportError(Exception):
    """A workbook can't be written."""


class ExprError(Exception):
    """An expression is malformed."""
