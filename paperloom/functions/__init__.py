"""Column functions (native expressions unless said otherwise)."""

from . import numbering, sheets, text  # noqa: F401
