"""Blocks as plain Python values, for the reader of rich text.

A document is a list of blocks. A block has a kind ``t`` (h, p, ul, ol, table or img) and the members of its
kind; the rest are null. Texts are runs with bold and italic flags.
"""

from __future__ import annotations

from typing import Any

MEMBERS = ("t", "level", "runs", "items", "rows", "data", "mime", "name", "alt")

Run = dict[str, Any]
Block = dict[str, Any]


class CodecError(Exception):
    """Carries the code that goes into the ``code`` column."""

    @property
    def code(self) -> str:
        return str(self.args[0])


def run(text: str, b: bool = False, i: bool = False) -> Run:
    return {"text": text or "", "b": bool(b), "i": bool(i)}


def block(t: str, **members: Any) -> Block:
    return {**dict.fromkeys(MEMBERS), "t": t, **members}


def paragraph(*runs: Run) -> Block:
    return block("p", runs=list(runs))


def image(data: bytes, mime: str, name: str = "image", alt: str = "") -> Block:
    return block("img", data=data, mime=mime, name=name, alt=alt)
