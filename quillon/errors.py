"""Errors by family. Each carries the payload its message names as attributes."""

from __future__ import annotations


class QuillonError(Exception):
    """Base of all errors of this library."""

    def __init__(self, message: str = "", **payload):
        super().__init__(message or self.__class__.__name__)
        self.__dict__.update(payload)


class InvalidQueryError(QuillonError):
    """The request does not fit the dataset's schema."""


class ExecutionError(QuillonError):
    """A valid request could not be carried out."""


class TransactionError(QuillonError):
    """A write was refused."""


class StorageError(QuillonError):
    """Stored objects are missing, broken or in the way."""


#: The names of the errors, by family.
def _family(base: type[QuillonError], names: str) -> None:
    for name in names.split():
        globals()[name] = type(name, (base,), {"__module__": __name__, "__doc__": None})


_family(
    InvalidQueryError,
    "ReservedColumn DuplicateSchemaColumn ZeroVectorDimensions UnknownColumn DuplicateProjection FilterTypeMismatch NonScalarFilterColumn "
    "InvalidComparisonOperator NonScalarGroupColumn DuplicateGroupColumn EmptyGroupBy DuplicateAggregateAlias InvalidAggregateOutputType "
    "InvalidAggregateType InvalidVectorK UnsupportedVectorColumn NotVectorColumn NonFiniteVectorComponent VectorDimensionMismatch UnsupportedType",
)
_family(
    ExecutionError,
    "UnsupportedTransactionRead PlannerError Int64SumOverflow TooManyVectorHits NegativeVectorDistance NonFiniteVectorDistance "
    "NonMonotonicVectorDistances UnexpectedHydration MissingHydration HydrationProjectionMismatch GroupResultShape NonScalarGroupResult "
    "NullCountAggregate AggregateResultTypeMismatch",
)
_family(PlannerError, "InvalidLogicalShape ConflictingTerminalOperators")  # noqa: F821
_family(
    TransactionError,
    "DatasetAlreadyExists DatasetNotFound NonFiniteStoredComponent ManifestOverflow RowIdReservationDurability IndeterminateManifestPublication "
    "UnreasonableCapacity BatchSchemaMismatch RowNotFound RowNotLive DuplicateTarget InvalidUpdateShape Conflict "
    "InsufficientHistory RowIdRangeMismatch ReservedColumnName Clock InvalidRetentionPolicy InvalidCompactionPolicy TransactionFinished",
)
_family(
    StorageError,
    "EmptyDataFile CorruptManifest UnsafeManifestPath CorruptDataFile CorruptSegment UnknownSchemaVersion MigrationSourceVersion "
    "MigrationUnsupportedDirection MigrationUnsupported MigrationIncompatibleType MigrationLossyConversion SchemaVersionChanged "
    "MissingRowIdHighWater DurabilityUnsupported ObjectAlreadyExists ObjectNotFound PublicationIndeterminate",
)
