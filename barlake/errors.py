"""One exception per gate family."""


class BarlakeError(RuntimeError):
    """Base class of all refusals."""


class SourceError(BarlakeError):
    """An input file or table cannot be read safely."""


class DataQualityError(BarlakeError):
    """A data-quality gate found violations."""


class ConflictError(DataQualityError):
    """The same key carries different values."""


class CommitError(BarlakeError):
    """Another writer committed first."""


class UniverseError(BarlakeError):
    """A universe cannot be built or validated."""


class IncompleteError(BarlakeError):
    """Ticker statuses block publication."""


class RefreshError(BarlakeError):
    """A refresh cannot be validated or committed."""


class ManifestError(BarlakeError):
    """A manifest or a managed file is invalid."""


class IdentityError(BarlakeError):
    """Two copies describe different datasets."""
