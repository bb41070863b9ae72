"""What the operators of this package share."""

from __future__ import annotations

from codeloom.storage import table, written

#: Where the public tokenizers lie; every function that needs one takes the path as a parameter.
TOKENIZERS = "/opt/tokenizers"

__all__ = ["TOKENIZERS", "table", "written"]
