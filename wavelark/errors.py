"""Errors of the library."""


class WaveError(Exception):
    """Any misuse or damage that the library tells of."""


class StoreError(WaveError):
    """A directory that is no store, or a damaged or incomplete one."""
