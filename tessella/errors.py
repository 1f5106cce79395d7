"""One exception hierarchy for all of the library."""


class TessellaError(Exception):
    """Base of all errors raised here."""


class InvalidQueryError(TessellaError):
    """The query is empty or lacks what it needs."""


class QuerySyntaxError(InvalidQueryError):
    """The query text can't be parsed."""


class UnsupportedOperatorError(TessellaError):
    """The operator isn't defined for this type of field."""


class InvalidValueError(TessellaError):
    """The literal isn't a value of the type."""


class InvalidFieldTypeError(TessellaError):
    """The field type is unknown."""


class NotFoundError(TessellaError):
    """A named thing isn't there."""


class CorruptedError(TessellaError):
    """Stored data doesn't match its checksum or layout."""


class AlreadyExistsError(TessellaError):
    """A thing of this name is there already."""


class AccessError(TessellaError):
    """Something about keys, roles or rules isn't allowed."""


class ConfigError(TessellaError):
    """A configuration value is out of its range."""


class TlvError(TessellaError):
    """A TLV item is malformed or of an unknown type."""
