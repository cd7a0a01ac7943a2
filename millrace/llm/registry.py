"""The queries of this subpackage, gathered from the modules of its operators."""

from __future__ import annotations

from . import automaton, bpe, exactdedup, fingerprint, langid, linededup, lloyd, mixing, ngramjoin, quality, sharding, spelling, suffixdedup

_MODULES = (linededup, ngramjoin, sharding, quality, exactdedup, suffixdedup, langid, automaton, mixing, bpe, fingerprint, lloyd, spelling)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
