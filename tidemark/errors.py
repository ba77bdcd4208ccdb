"""Error kinds of the store."""


class StoreError(Exception):
    """Anything the store reports."""


class Corrupted(StoreError):
    """Bytes or a manifest that cannot be what was written; `where` names the file or record."""

    def __init__(self, what: str, where: str = ""):
        super().__init__(f"{what} ({where})" if where else what)
        self.where = where


class BatchHeaderError(Corrupted):
    """A batch that begins before the sequence number that is due."""

    def __init__(self, expected: int, found: int):
        super().__init__(f"batch begins at {found}, expected {expected} or more")
        self.expected, self.found = expected, found


class NotFound(StoreError, KeyError):
    """No live version of the key at the snapshot."""


class Closed(StoreError):
    """The store has been closed."""


class Conflict(StoreError):
    """Another writer committed this version first; plan again from the new one."""


class ReadOnly(StoreError):
    """A write to a store that was opened for reading."""
