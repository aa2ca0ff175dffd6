"""The secret that scopes deduplication: 32 random bytes in a file that only its owner reads."""

from __future__ import annotations

import os

SALT_BYTES = 32


def salt_of(path: str) -> bytes:
    """The salt in the file, which is made if it is not there (mode 0600, and its folder)."""
    try:
        with open(path, "rb") as f:
            salt = f.read()
    except FileNotFoundError:
        os.makedirs(os.path.dirname(os.path.abspath(path)), mode=0o700, exist_ok=True)
        salt = os.urandom(SALT_BYTES)
        try:
            fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        except FileExistsError:  # another process was first
            return salt_of(path)
        with os.fdopen(fd, "wb") as f:
            f.write(salt)
    if len(salt) != SALT_BYTES:
        raise ValueError(f"{path} does not hold {SALT_BYTES} bytes")
    return salt
