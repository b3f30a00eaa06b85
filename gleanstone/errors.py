"""Errors that stop a run; failures of single rows are values in a column instead."""


class GleanstoneError(Exception):
    """Any refusal of this engine."""


class ConfigError(GleanstoneError):
    """A setting or mapping that can't be used."""


class SourceError(GleanstoneError):
    """An input that can't be read as a whole."""


class WindowError(GleanstoneError):
    """A window that is missing, present already, or inconsistent with what is asked of it."""


class LeakError(GleanstoneError):
    """Personal data in texts about to be written."""
