"""What can go wrong, by the part of the engine that notices."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors of this engine."""

    #: Whether trying the same call again may help.
    retryable = False


class ConfigurationError(EngineError):
    """A declaration, option or configuration file that can't be used."""


class SchemaError(EngineError):
    """Rows that don't have the declared fields."""


class ComponentNotFoundError(EngineError):
    """A component that the workspace doesn't have."""


class ResourceNotFoundError(EngineError):
    """A resource that the workspace doesn't have."""


class RowNotFoundError(EngineError):
    """A row that isn't there."""


class StoreError(EngineError):
    """State or a checkpoint that can't be read or written."""


class SchedulerError(EngineError):
    """Unknown pipelines, cycles and the like."""


class SystemExecutionError(EngineError):
    """A user's system failed."""

    retryable = True


class PermanentError(SystemExecutionError):
    """A failure that another try can't mend."""

    retryable = False


class DistributedError(EngineError):
    """Work that was lost with the machine that had it."""

    retryable = True


class RetryExhaustedError(EngineError):
    """All tries failed; the last failure is the cause."""

    def __init__(self, attempts: int, cause: BaseException):
        super().__init__(f"gave up after {attempts} attempts: {cause}")
        self.attempts = attempts
        self.__cause__ = cause
