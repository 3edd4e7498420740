"""The queries of this subpackage and their SQL."""

from importlib import import_module

MODULES = ("quality", "mixing", "simhash", "packing", "langid", "bytededup", "linededup", "licenses", "htmltext", "neighbours", "minhash", "align", "trie")
_ALL = [import_module(f"corpusloom.llm.{m}") for m in MODULES]
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _ALL for k, s in m.ORACLE.items()}
