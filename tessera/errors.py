"""Errors with the status codes of the store's contract."""

from __future__ import annotations

#: The codes an operation can end with.
CODES = ("OK", "INVALID_ARGUMENT", "NOT_FOUND", "ALREADY_EXISTS", "UNIMPLEMENTED", "INTERNAL", "IO_ERROR", "CORRUPTION")


class EngineError(Exception):
    """str() reads `CODE: message`, or the code alone."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        self.code, self.message = code, message
        super().__init__(f"{code}: {message}" if message else code)


def invalid(message: str) -> EngineError:
    return EngineError("INVALID_ARGUMENT", message)
